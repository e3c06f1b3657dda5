"""Streaming ingest and the command line."""

from keystrata import cli
from keystrata.plans.store import Options, Store
from keystrata.schema import CHANGE_LOG
from keystrata.streaming.ingest import change_stream, ingest, live_stream


def test_ingest_is_idempotent(spark, tmp_path, store_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([(b"a", 1, 0, b"1"), (b"b", 2, 0, b"2")], CHANGE_LOG).coalesce(1).write.parquet(folder)
    store = Store(spark, store_path, Options(auto_compact=False))
    ingest(change_stream(spark, folder), store, f"{tmp_path}/c1").awaitTermination()
    spark.createDataFrame([(b"a", 1, 1, b"")], CHANGE_LOG).coalesce(1).write.mode("append").parquet(folder)
    ingest(change_stream(spark, folder), store, f"{tmp_path}/c1").awaitTermination()
    assert {bytes(r["key"]) for r in store.view().collect()} == {b"b"}
    runs = store.run_count
    ingest(change_stream(spark, folder), store, f"{tmp_path}/c2").awaitTermination()  # a lost checkpoint replays batch ids
    assert store.run_count == runs


def test_running_live_view(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame([(b"a", 2, 0, b"new"), (b"a", 1, 0, b"old"), (b"b", 3, 1, b"")], CHANGE_LOG).write.parquet(folder)
    q = live_stream(change_stream(spark, folder)).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(bytes(r["key"]), bytes(r["value"])) for r in spark.table("live").collect()] == [(b"a", b"new")]


def test_cli(spark, store_path, capsys):
    def call(*args):
        code = cli.main([store_path, *args], spark)
        return code, capsys.readouterr().out

    assert call("put", "k1", "v1") == (0, "OK\n") and call("put", "k2", "v2")[0] == 0
    assert call("get", "k1") == (0, "v1\n")
    assert call("del", "k1") == (0, "OK\n") and call("get", "k1") == (1, "")
    assert call("scan", "k", "l") == (0, "k2\tv2\n")
