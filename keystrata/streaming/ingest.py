"""Streaming ingest: micro-batches of a change log become runs of a store, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators.resolve import live
from keystrata.plans.store import Store
from keystrata.schema import CHANGE_LOG


def change_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A stream of change-log Parquet files (key, seq, op, value), rate-limited by files a trigger."""
    reader = spark.readStream.schema(CHANGE_LOG)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Load every micro-batch under its batch id; a batch replayed after a failure is recognised and ignored."""

    def load(batch: DataFrame, batch_id: int) -> None:
        store.load(batch, batch=f"{name}:{batch_id}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_stream(stream: DataFrame) -> DataFrame:
    """The running newest row of each key; for complete or update output. Order of arrival doesn't matter."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq")
    return stream.groupBy("key").agg(newest.alias("__n")).select("key", "__n.*")


def live_stream(stream: DataFrame) -> DataFrame:
    """The running live view, for complete output."""
    return live(newest_stream(stream)).select("key", "value")
