"""Helpers the corpus operators share: reading tables, scratch tables, skew-safe group lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_local_scratch: dict[str, str] = {}
_passing: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder all executors share: spark.checkpoint.dir, or in local mode without it a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = "file://" + tempfile.mkdtemp(prefix="keystrata-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/keystrata-{uuid.uuid4().hex}-{tag}"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables materialized within go when the block ends; what is to stay is materialized with keep=True."""
    folder = scratch_path(spark, "passing")
    _passing.append(folder)
    try:
        yield
    finally:
        _passing.pop()
        drop_path(spark, folder)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared scratch folder and read it back.

    Unlike a local checkpoint it survives lost executors, and it is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag) if keep or not _passing else f"{_passing[-1]}/{uuid.uuid4().hex[:8]}-{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


ROW_KEY = ["__file", "__row"]


def row_keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns (all by default) with ROW_KEY, which names each row, whatever it holds, and is the same whenever it is evaluated.

    Rows read straight from files are named by file and place; any other table is written once with numbers.
    """
    names = [f"`{c}`" for c in dict.fromkeys(columns or docs.columns)]
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName().startswith("LogicalRelation") and "_metadata" not in docs.columns:
        return docs.select(*names, F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return materialize(docs.select(*names, F.lit(0).cast("long").alias("__file"), F.monotonically_increasing_id().alias("__row")), "keyed-rows", keep=True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. `lower` has a fast path for ASCII, where both agree."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def spread_of(spark: SparkSession) -> int:
    """How many parts a hot key is cut into: a power of two, at least 64, at least the shuffle partitions."""
    want = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = 64
    while n < want:
        n *= 2
    return n


def attach_group(rows: DataFrame, keys: Sequence[str], spread_by: Column, aggs: dict[str, tuple[Column, str]]) -> DataFrame:
    """Give every row its group's aggregates without ever holding one group in one task.

    aggs: name -> (aggregate over rows, name of the aggregate function that merges partial results).
    Rows are dealt to `spread_of` runs by `spread_by`; each run is aggregated per key, the few run
    results per key are merged, handed back to the runs, and rows join on (key, run). A key that owns
    a third of all rows is thus shared by all runs in both directions.
    """
    spread = spread_of(rows.sparkSession)
    keyed = rows.withColumn("__run", F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("int"))
    runs = keyed.groupBy(*keys, "__run").agg(*(agg.alias(name) for name, (agg, _) in aggs.items()))
    tops = runs.groupBy(*keys).agg(*(getattr(F, merge)(name).alias(name) for name, (_, merge) in aggs.items()))
    back = runs.select(*keys, "__run").join(tops, list(keys))
    return keyed.join(back, [*keys, "__run"]).drop("__run")


HOT_KEYS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Inner join of rows to groups, which has one row for each of some keys and the number `n` of its rows.

    Keys that own more than 1/HOT_KEYS of the `total` rows are fewer than HOT_KEYS, so they are broadcast and their
    rows aren't shuffled; no key of the rest owns more than that share.
    """
    limit = max(64, total // HOT_KEYS)
    hot, cold = groups.filter(F.col(n) > limit), groups.filter(F.col(n) <= limit)
    loud = rows.join(F.broadcast(hot), list(keys))
    quiet = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return loud.unionByName(quiet)
