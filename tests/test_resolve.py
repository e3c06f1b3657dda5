"""Newest wins, tombstones shadow, filters come after; byte keys order as bytes."""

import random

from pyspark.sql import functions as F

from keystrata.operators import lookup, resolve
from keystrata.schema import CHANGE_LOG

ROWS = [(b"a", 1, 0, b"1"), (b"b", 2, 0, b"2"), (b"a", 3, 0, b"3"), (b"b", 4, 1, b""), (b"c", 5, 1, b""), (b"d", 6, 0, b"old"), (b"d", 7, 1, b""), (b"d", 8, 0, b""), (b"x\x00y", 9, 0, b"\x00\xff")]
LIVE = {b"a": b"3", b"d": b"", b"x\x00y": b"\x00\xff"}


def frame(spark, rows):
    return spark.createDataFrame(rows, CHANGE_LOG)


def as_dict(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.select("key", "value").collect()}


def test_newest_wins_tombstones_shadow_and_puts_revive(spark):
    assert as_dict(resolve.live_view(frame(spark, ROWS))) == LIVE


def test_result_does_not_depend_on_input_order(spark):
    rows = ROWS * 1
    random.Random(3).shuffle(rows)
    assert as_dict(resolve.live_view(frame(spark, rows).repartition(3))) == LIVE


def test_three_plans_agree(spark):
    log = frame(spark, ROWS)
    want = {tuple(r) for r in resolve.newest_per_key(log).collect()}
    assert {tuple(r) for r in resolve.newest_per_key_window(log).select(log.columns).collect()} == want
    assert {tuple(r) for r in resolve.newest_per_key_late(log).select(log.columns).collect()} == want


def test_value_filter_after_resolve_does_not_resurrect(spark):
    log = frame(spark, [(b"k", 1, 0, b"match"), (b"k", 2, 0, b"other")])
    assert resolve.live_view(log).filter(F.col("value") == F.lit(b"match")).count() == 0


def test_keys_order_as_unsigned_bytes(spark):
    keys = [b"", b"\x00", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff"]
    log = frame(spark, [(k, i, 0, b"v") for i, k in enumerate(reversed(keys))])
    got = [bytes(r["key"]) for r in resolve.live_view(log).orderBy("key").collect()]
    assert got == sorted(keys)
    assert {bytes(r["key"]) for r in lookup.range_scan(log, b"a", b"\x80").collect()} == {b"a", b"a\x00", b"\x7f"}


def test_ranges_are_half_open_and_empty_when_reversed(spark):
    log = frame(spark, ROWS)
    assert as_dict(lookup.range_scan(log, b"a", b"d")) == {b"a": b"3"}
    assert as_dict(lookup.range_scan(log, b"b", b"b")) == {} == as_dict(lookup.range_scan(log, b"z", b"a"))


def test_point_and_multi_get(spark):
    log = frame(spark, ROWS)
    assert as_dict(lookup.point_get(log, b"a")) == {b"a": b"3"}
    assert as_dict(lookup.point_get(log, b"b")) == as_dict(lookup.point_get(log, b"nope")) == {}
    keys = lookup.keys_frame(spark, [b"a", b"a", b"b", b"nope", b"d"])
    assert as_dict(lookup.multi_get(log, keys)) == as_dict(lookup.multi_get(log, keys, max_broadcast=0)) == {b"a": b"3", b"d": b""}


def test_shadowing_counts_tombstones(spark):
    older, newer = frame(spark, [(b"a", 1, 0, b"x"), (b"b", 2, 0, b"y")]), frame(spark, [(b"a", 3, 1, b"")])
    assert as_dict(resolve.shadowed_by(older, newer)) == {b"b": b"y"}


def test_merge_keeps_or_drops_tombstones(spark):
    runs = frame(spark, [(b"gone", 1, 0, b"was"), (b"k", 2, 0, b"v"), (b"gone", 3, 1, b"")])
    assert resolve.merge_runs(runs, False).count() == 2
    assert as_dict(resolve.merge_runs(runs, True)) == {b"k": b"v"}


def test_empty_log(spark):
    assert resolve.live_view(frame(spark, [])).count() == 0


def test_key_predicate_reaches_the_scan(spark, tmp_path):
    frame(spark, ROWS).write.parquet(f"{tmp_path}/log")
    plan = lookup.point_get(spark.read.parquet(f"{tmp_path}/log"), b"a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan
    plan = lookup.range_scan(spark.read.parquet(f"{tmp_path}/log"), b"a", b"c")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
