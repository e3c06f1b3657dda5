"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import bpe, decontamination, exact_dedup, html_extract, lm_scoring, near_dedup, quality, substring_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_warc": warc.op3_warc,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_bpe": bpe.op5_bpe,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_html_extraction": html_extract.op7_html_extraction,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_quality": quality.op9_quality,
        "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": near_dedup.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op8_substring_dedup": substring_dedup.OP8_SQL,
    }
