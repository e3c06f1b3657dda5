"""Exact deduplication: tree-merge of sorted digest runs, in DataFrame operations only.

Every row becomes a verified digest (SHA-256, byte length and a second, independent 64-bit hash of the
normalised text) beside the row's place, written once. Rows are dealt to runs, at least as many as there are shuffle partitions. Round 0 sorts each
run and reduces it to one entry per digest; each later round exchanges entries so that `fan_in` neighbouring
runs (run >> log2(fan_in)) meet, and merges them by a sort and a sorted aggregation, retaining per digest the identifier that
stays (the whole verified digest must agree) and the size, until one run is left. A round is partitioned by (run, digest), with entries combined before
the exchange, so no run is ever one task. The verdict then walks the same tree downwards: the final entry
is joined to the entries of the round before, and at last to the rows by (run, digest). A digest that owns a
third of all rows has at most one entry per run on each level.

Defined cases: null text counts as empty, and empty texts are equal to each other; rows with the same
identifier are separate rows, of which one stays at most; a null identifier never stays if another row of its group has one; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import ROW_KEY, ascii_lower, materialize, passing_tables, row_keyed, spread_of, table

DIGEST = ["__sha", "__len", "__check"]


def digest_rows(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64) -> DataFrame:
    """ROW_KEY, __id, __sha, __len, __check, __run of each row; the text stays behind at the scan."""
    norm = keyed.select(*ROW_KEY, F.col(id_col).alias("__id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__norm"))
    return norm.select(
        *ROW_KEY,
        "__id",
        F.unhex(F.sha2("__norm", 256)).alias("__sha"),
        F.octet_length("__norm").alias("__len"),
        F.xxhash64("__norm").alias("__check"),
        F.pmod(F.xxhash64(*ROW_KEY), F.lit(runs)).cast("int").alias("__run"),
    )


def exact_verdicts(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "min", fan_in: int = 8) -> DataFrame:
    """ROW_KEY, __id, keep_id, group_size, kept, text_sha256 of each row of `keyed`, which holds ROW_KEY."""
    if stays not in ("min", "max") or fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("stays is min or max, fan_in a power of two")
    best = getattr(F, stays)
    runs, shift = spread_of(keyed.sparkSession), fan_in.bit_length() - 1
    rows = materialize(digest_rows(keyed, id_col, text_col, runs), "digests", keep=True)
    # a null identifier comes last, whichever end stays; equal identifiers are told apart by place
    last = F.col("__id").isNull() if stays == "min" else F.col("__id").isNotNull()
    named = F.struct(last.alias("last"), "__id", *ROW_KEY)
    with passing_tables(keyed.sparkSession):
        # the smallest struct is kept by a sorted aggregation: runs are sorted by digest and merged in order
        levels = [materialize(rows.groupBy("__run", *DIGEST).agg(best(named).alias("__keep"), F.count(F.lit(1)).alias("__size")), "run-0")]
        while runs > 1:
            up = levels[-1].withColumn("__run", F.shiftright("__run", shift))
            levels.append(materialize(up.groupBy("__run", *DIGEST).agg(best("__keep").alias("__keep"), F.sum("__size").alias("__size")), f"run-{len(levels)}"))
            runs = -(-runs // fan_in)
        verdict = levels.pop()
        while levels:
            below = levels.pop().select(F.col("__run").alias("__below"), *DIGEST, F.shiftright("__run", shift).alias("__run"))
            verdict = below.join(verdict, ["__run", *DIGEST]).select(F.col("__below").alias("__run"), *DIGEST, "__keep", "__size")
        verdict = materialize(verdict, "verdicts", keep=True)
    out = rows.join(verdict, ["__run", *DIGEST])
    return out.select(
        *ROW_KEY,
        "__id",
        F.col("__keep.__id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        ((F.col("__file") == F.col("__keep.__file")) & (F.col("__row") == F.col("__keep.__row"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "min", fan_in: int = 8) -> DataFrame:
    """One row per input row: `id_col`, keep_id, group_size, kept, text_sha256.

    stays: "min" or "max", which identifier of a group of equal texts stays.
    """
    out = exact_verdicts(row_keyed(docs, id_col, text_col), id_col, text_col, stays, fan_in)
    return out.select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), stays="max")


OP2_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
