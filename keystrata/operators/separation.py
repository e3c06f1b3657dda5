"""Value separation: large values leave the runs, so merges move only references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.schema import PUT


def is_large(value: Column, threshold: int | None) -> Column:
    """Inclusive threshold; None separates nothing."""
    return F.lit(False) if threshold is None else F.octet_length(value) >= threshold


def split_values(log: DataFrame, generation: int, threshold: int | None) -> tuple[DataFrame, DataFrame]:
    """(values, run): values (id, key, value) to be made durable first, and the run that refers to them."""
    out = (F.col("op") == PUT) & is_large(F.col("value"), threshold)
    values = log.filter(out).select(F.col("seq").alias("id"), "key", "value")
    ref = F.struct(F.lit(generation).alias("gen"), F.col("seq").alias("id"), F.octet_length("value").alias("len"))
    run = log.select("key", "seq", "op", F.when(out, F.lit(None)).otherwise(F.col("value")).alias("value"), F.when(out, ref).alias("vref"))
    return values, run


def dereference(rows: DataFrame, values: DataFrame | None) -> DataFrame:
    """Fill separated values in; join after resolving, so shadowed values are never read."""
    if values is None:
        return rows.drop("vref")
    found = values.select(F.col("gen").alias("__gen"), F.col("id").alias("__id"), F.col("value").alias("__value"))
    on = (rows["vref.gen"] == found["__gen"]) & (rows["vref.id"] == found["__id"])
    joined = rows.join(found, on, "left").withColumn("value", F.coalesce("value", "__value"))
    return joined.drop("__gen", "__id", "__value", "vref")
