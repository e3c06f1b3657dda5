"""Runs as Parquet: sorted by key, range-partitioned, with statistics and Bloom filters on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.scalar import record_bytes
from keystrata.schema import RUN
from keystrata.sources import files
from keystrata.sources.manifest import RunInfo

BLOOM_FPP = 0.01
FILTERED_AT_ONCE = 1 << 22  # records, so at most 10 MB of filters come to the driver by one job


def writer(df: DataFrame, expected: int | None, block_bytes: int | None = None):
    w = df.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(BLOOM_FPP))
    if expected:
        w = w.option("parquet.bloom.filter.expected.ndv#key", str(max(expected, 1)))
    if block_bytes:
        w = w.option("parquet.block.size", str(block_bytes))
    return w


def write_run(df: DataFrame, path: str, parts: int, expected: int | None = None, together: int = 1) -> None:
    """Write resolved rows as one run of about `parts` key-disjoint sorted files of `expected` rows; a task writes `together` of them."""
    tasks = -(-parts // together) if expected else parts
    ranged = df.repartitionByRange(tasks, "key") if tasks > 1 else df.coalesce(1)
    w = writer(ranged.sortWithinPartitions("key"), expected)
    (w.option("maxRecordsPerFile", expected) if tasks < parts else w).parquet(path)


def describe(spark: SparkSession, path: str, name: str, level: int, split: bool = False) -> list[RunInfo]:
    """Statistics of a written run; with `split`, one entry for each of its files. Reads no values' bytes of others."""
    df = spark.read.schema(RUN).parquet(path)
    by = F.input_file_name() if split else F.lit(path)
    size = F.sum(record_bytes(F.col("key"), F.col("value"), F.col("vref").isNotNull()))
    stats = df.groupBy(by.alias("file")).agg(
        F.count(F.lit(1)).alias("records"), F.sum((F.col("op") == 1).cast("long")).alias("tombstones"), size.alias("bytes"),
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("seq").alias("seq"),
    )
    rows = sorted(stats.collect(), key=lambda r: bytes(r["lo"]))  # a row a file
    return [
        RunInfo(name if not split else f"{name}.{i:04d}", r["file"], level, r["records"], r["tombstones"], r["bytes"], bytes(r["lo"]), bytes(r["hi"]), r["seq"])
        for i, r in enumerate(rows)
    ]


def read_runs(spark: SparkSession, runs: list[RunInfo], bloom: bool = True) -> DataFrame | None:
    """All rows of the runs, by explicit paths; None without runs."""
    if not runs:
        return None
    return spark.read.schema(RUN).option("parquet.filter.bloom.enabled", str(bloom).lower()).parquet(*[r.path for r in runs])


def filter_batches(runs: list[RunInfo]) -> list[list[RunInfo]]:
    """Runs whose filters one job may build: single files, alike in records by a factor of two; the others by themselves."""
    out: dict[tuple, list[list[RunInfo]]] = {}
    for r in runs:
        kind = (r.records.bit_length(),) if "." in r.name else (r.name,)
        batches = out.setdefault(kind, [[]])
        if (len(batches[-1]) + 1) << r.records.bit_length() > FILTERED_AT_ONCE and batches[-1]:
            batches.append([])
        batches[-1].append(r)
    return [b for batches in out.values() for b in batches]


def may_hold(run: RunInfo, key: bytes) -> bool:
    return run.min_key <= key <= run.max_key


def meets(run: RunInfo, start: bytes, end: bytes) -> bool:
    """Whether a run's closed range meets the half-open [start, end)."""
    return run.max_key >= start and run.min_key < end


def orphans(spark: SparkSession, folder: str, live: set[str]) -> list[str]:
    """Run folders and temporaries that no retained manifest names."""
    return [n for n in files.names(spark, folder) if n not in live]
