"""A corpus pipeline: toxicity filter, exact and near deduplication, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a DataFrame; all
but the last return the columns of documents. Verdicts are about rows, told apart by their place in docs:
rows with null, equal or clashing identifiers are judged by their own text, and of equal rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import bpe, decontamination, exact_dedup, near_dedup, toxicity
from keystrata.llm.common import ROW_KEY, materialize, row_keyed, table


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """keyed without the rows in dropped; the columns of documents."""
    return keyed.join(dropped.select(*ROW_KEY).distinct(), ROW_KEY, "left_anti").drop(*ROW_KEY)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from labelled documents, then drop documents with a toxicity score of 0.5 or more."""
    caps = {1: toxicity.MAX_TOXIC, 0: toxicity.MAX_CLEAN}
    machine = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), "toxic", caps))
    return toxicity.without_toxic(docs, machine)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier stays."""
    keyed = row_keyed(docs)
    return _without(keyed, exact_dedup.exact_verdicts(keyed).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of texts that share 0.8 or more of their five-word shingles one document stays."""
    keyed = row_keyed(docs)
    return _without(keyed, near_dedup.near_verdicts(keyed).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    keyed = row_keyed(docs)
    return _without(keyed, decontamination.contaminated_rows(keyed, table(spark, sf_dir, "benchmark")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of the ids and of the decoded bytes."""
    return bpe.encoded(docs, *bpe.public_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
