"""Which runs to merge: decisions over the manifest, which is small; the merges themselves are DataFrames."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.scalar import level_budget_of, size_bucket_of
from keystrata.sources.manifest import RunInfo


@dataclass(frozen=True)
class Pick:
    """Runs to merge, the level of the result, and whether tombstones may go; with `move` they only change level."""

    runs: tuple[RunInfo, ...]
    level: int
    drop_tombstones: bool
    move: bool = False


def reaches_oldest(all_runs: Sequence[RunInfo], picked: Sequence[RunInfo]) -> bool:
    """Whether `picked` is an unbroken tail, so that nothing older could come back."""
    return list(all_runs[len(all_runs) - len(picked) :]) == list(picked)


def pick_tiered(runs: Sequence[RunInfo], min_merge: int = 4, ratio: float = 2.0) -> Pick | None:
    """From runs newest first: neighbours in age and equal in size class, at least min_merge of them.

    The smallest class wins, of equals the newest group.
    """
    groups: list[tuple[int, list[RunInfo]]] = []
    for r in runs:
        bucket = size_bucket_of(r.bytes, ratio)
        if groups and groups[-1][0] == bucket:
            groups[-1][1].append(r)
        else:
            groups.append((bucket, [r]))
    full = [g for g in groups if len(g[1]) >= min_merge]
    if not full:
        return None
    picked = min(full, key=lambda g: g[0])[1]
    return Pick(tuple(picked), 0, reaches_oldest(runs, picked))


def overlaps(a: RunInfo, low: bytes, high: bytes) -> bool:
    """Closed key ranges meet."""
    return not (a.max_key < low or a.min_key > high)


def pick_leveled(runs: Sequence[RunInfo], min_merge: int, first_budget: int, ratio: float = 2.0) -> Pick | None:
    """All of level 0 if it has min_merge runs, else as many of the lowest-range runs of the shallowest level over
    budget as bring it within; together with what overlaps on the level below.

    The first of these runs that meet nothing below, and have no tombstones that may go, are moved instead of merged.
    So a level takes at most one move and one merge, however many runs it is over by.
    """
    by_level: dict[int, list[RunInfo]] = {}
    for r in runs:
        by_level.setdefault(r.level, []).append(r)
    if len(by_level.get(0, [])) >= min_merge:
        source, level = list(by_level[0]), 0
    else:
        over = [n for n in sorted(by_level) if n >= 1 and sum(r.bytes for r in by_level[n]) > level_budget_of(n, first_budget, ratio)]
        if not over:
            return None
        level = over[0]
        excess, source = sum(r.bytes for r in by_level[level]) - level_budget_of(level, first_budget, ratio), []
        for r in sorted(by_level[level], key=lambda r: r.min_key):
            if excess <= 0:
                break
            source.append(r)
            excess -= r.bytes
    deeper = any(n > level + 1 for n in by_level)
    if level:
        ranges = sorted(by_level.get(level + 1, []), key=lambda r: r.min_key)

        def apart(r: RunInfo) -> bool:
            i = bisect_left(ranges, r.min_key, key=lambda b: b.max_key)
            return (deeper or not r.tombstones) and (i == len(ranges) or not overlaps(ranges[i], r.min_key, r.max_key))

        if moved := tuple(takewhile(apart, source)):
            return Pick(moved, level + 1, not deeper, move=True)
    low, high = min(r.min_key for r in source), max(r.max_key for r in source)
    below = [r for r in by_level.get(level + 1, []) if overlaps(r, low, high)]
    return Pick(tuple(source + below), level + 1, not deeper)


def size_tiers(runs: DataFrame, bucket: str = "bucket", age: str = "run") -> DataFrame:
    """Gaps and islands over a run table: (bucket, island, n, oldest, newest), newest first in age."""
    by_age = Window.orderBy(F.desc(age))
    in_bucket = Window.partitionBy(bucket).orderBy(F.desc(age))
    island = F.row_number().over(by_age) - F.row_number().over(in_bucket)
    marked = runs.withColumn("island", island.cast("long"))
    return marked.groupBy(bucket, "island").agg(F.count(F.lit(1)).alias("n"), F.min(age).alias("oldest"), F.max(age).alias("newest"))


def split_points(rows: DataFrame, size: Column, target: float, key: str = "key", parts: int = 64) -> DataFrame:
    """Give each row, in key order, the number of the output file it falls into when files hold `target` bytes.

    A two-level prefix sum: rows are range-partitioned by key, partitions are summed, and each adds the sum of
    those before it, so no single task orders the whole table.
    """
    ranged = rows.withColumn("__size", size.cast("long")).repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id())
    sums = ranged.groupBy("__part").agg(F.sum("__size").alias("__bytes"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__bytes").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum("__size").over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.withColumn("__inner", inner).join(F.broadcast(before.select("__part", "__before")), "__part")
    return joined.withColumn("file_no", F.floor((F.col("__inner") + F.col("__before") - 1) / F.lit(float(target))).cast("long")).drop("__size", "__part", "__inner", "__before")
