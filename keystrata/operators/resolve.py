"""Resolving a change log: newest row per key, then liveness. Filters on values come after, never before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.schema import DELETE, PUT


def newest_per_key(log: DataFrame, key: str | list[str] = "key", order: str | list[str] = "seq") -> DataFrame:
    """One row per key, the one with the greatest order; all columns of the input.

    A single aggregation with map-side combine: only one candidate per key and task is shuffled. A predicate on
    the key placed on the result is pushed by Catalyst through the aggregate into the scan.
    """
    keys = [key] if isinstance(key, str) else key
    by = [order] if isinstance(order, str) else order
    rest = [c for c in log.columns if c not in keys]
    rank = F.col(by[0]) if len(by) == 1 else F.struct(*by)
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__newest"))
    return picked.select(*[F.col(c) if c in keys else F.col("__newest")[c].alias(c) for c in log.columns])


def newest_per_key_late(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The same by a narrow hash aggregation and a join back, for wide values with many versions per key."""
    top = log.groupBy(key).agg(F.max(order).alias(order))
    return log.join(top, [key, order], "left_semi")


def newest_per_key_window(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The same by a window; kept as a cross-check."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def live(resolved: DataFrame) -> DataFrame:
    """Rows whose newest operation is a put."""
    return resolved.filter(F.col("op") == PUT)


def tombstones(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("op") == DELETE)


def live_view(log: DataFrame, key: str = "key", order: str | list[str] = "seq") -> DataFrame:
    return live(newest_per_key(log, key, order))


def union_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def merge_runs(runs: DataFrame, drop_tombstones: bool, key: str | list[str] = "key", order: str = "seq") -> DataFrame:
    """K-way merge of runs: newest per key. Tombstones may be dropped only if nothing older is left out."""
    merged = newest_per_key(runs, key, order)
    return live(merged) if drop_tombstones else merged


def shadowed_by(older: DataFrame, newer: DataFrame, key: str | list[str] = "key") -> DataFrame:
    """The rows of `older` that no row of `newer` shadows; a tombstone shadows too."""
    return older.join(newer.select(key), key, "left_anti")


def revived(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Live keys with deletes before their newest put, and how many."""
    newest = F.max_by("op", order)
    agg = log.groupBy(key).agg(newest.alias("op"), F.sum(F.col("op").cast("long")).alias("deletes_before"))
    return agg.filter((F.col("op") == PUT) & (F.col("deletes_before") > 0)).select(key, "deletes_before")


def versions(log: DataFrame, key: str = "key") -> DataFrame:
    """Versions per key and how many of them are shadowed: the space amplification."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("versions"), (F.count(F.lit(1)) - 1).alias("shadowed"))


def history(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Each version with the one before and after it."""
    w = Window.partitionBy(key).orderBy(order)
    return log.withColumn("previous", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def as_of(log: DataFrame, bound: Column, key: str = "key", order: str = "seq") -> DataFrame:
    """The live view at an older commit point."""
    return live_view(log.filter(bound), key, order)
