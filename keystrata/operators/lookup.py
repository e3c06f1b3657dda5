"""Reads: point, batched and half-open range lookups. Key predicates go below the resolve, value predicates above."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators.resolve import live_view

BROADCAST_KEYS = 1_000_000


def point_get(log: DataFrame, key, name: str = "key", order: str = "seq") -> DataFrame:
    """No row for an absent or deleted key, else its newest put."""
    return live_view(log.filter(F.col(name) == F.lit(key)), name, order)


def range_scan(log: DataFrame, start, end, name: str = "key", order: str = "seq") -> DataFrame:
    """start <= key < end, live only; empty if start >= end. Sort the result by key where order matters."""
    if start >= end:
        return live_view(log.filter(F.lit(False)), name, order)
    return live_view(log.filter((F.col(name) >= F.lit(start)) & (F.col(name) < F.lit(end))), name, order)


def multi_get(log: DataFrame, keys: DataFrame, name: str = "key", order: str = "seq", max_broadcast: int = BROADCAST_KEYS) -> DataFrame:
    """The live rows of all wanted keys in one job: a semi-join below the resolve.

    The key set is broadcast only if a bounded count proves it small; else both sides are shuffled by key, which
    the following aggregation reuses.
    """
    wanted = keys.select(name).distinct()
    if keys.limit(max_broadcast + 1).count() <= max_broadcast:
        wanted = F.broadcast(wanted)
    return live_view(log.join(wanted, name, "left_semi"), name, order)


def keys_frame(spark, keys: Iterable[bytes]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key binary")


def read_probes(runs: DataFrame, run: str = "run", key: str = "key") -> DataFrame:
    """How many runs a newest-first search looks at until it finds each key."""
    newest = runs.agg(F.max(run).alias("__top"))
    first = runs.groupBy(key).agg(F.max(run).alias("__hit"))
    return first.crossJoin(F.broadcast(newest)).select(key, (F.col("__top") - F.col("__hit") + 1).alias("probes"))
