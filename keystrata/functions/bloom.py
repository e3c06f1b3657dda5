"""Bloom filters of runs, built by Spark's own distributed aggregate and kept beside the run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


class RunFilter:
    """Membership filter over keys; never says no to a key that is there."""

    def __init__(self, jfilter):
        self._filter = jfilter

    @classmethod
    def build(cls, keys: DataFrame, column: str = "key", expected: int = 1, fpp: float = 0.01) -> RunFilter:
        """Aggregate a filter over the column's hex form; partial filters merge on the executors."""
        hexed = keys.select(F.hex(column).alias("h"))
        return cls(hexed._jdf.stat().bloomFilter("h", max(int(expected), 1), float(fpp)))

    @classmethod
    def build_each(cls, keys: DataFrame, column: str = "key", expected: int = 1, fpp: float = 0.01) -> dict[str, RunFilter]:
        """One filter for each file of `keys`, by its name, all in one job; `expected` is the most keys a file has."""
        spark, n = keys.sparkSession, max(int(expected), 1)
        bits = max(1, int(-n * math.log(fpp) / math.log(2) ** 2))
        made = InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", F.hex(column), F.lit(n).cast("long"), F.lit(bits).cast("long"))
        rows = keys.groupBy(F.input_file_name().alias("file")).agg(made.alias("filter")).collect()  # a row a file
        jvm = spark.sparkContext._jvm
        return {r["file"]: cls(jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(jvm.java.io.ByteArrayInputStream(bytes(r["filter"])))) for r in rows}

    def might_contain(self, key: bytes) -> bool:
        return self._filter.mightContainString(key.hex().upper())

    @property
    def bits(self) -> int:
        return self._filter.bitSize()

    def save(self, spark: SparkSession, path: str) -> None:
        out = _file_system(spark, path).create(_path(spark, path), True)
        self._filter.writeTo(out)
        out.close()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RunFilter:
        stream = _file_system(spark, path).open(_path(spark, path))
        try:
            return cls(spark.sparkContext._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(stream))
        finally:
            stream.close()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
