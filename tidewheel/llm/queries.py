"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import op1_pii, op2_records, op3_jaccard, op4_substrings, op5_digest, op6_embeddings, op7_bpe, op8_toxicity, op9_counts, op10_pack


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii.query,
        "op2_records": op2_records.query,
        "op3_jaccard": op3_jaccard.query,
        "op4_substrings": op4_substrings.query,
        "op5_digest": op5_digest.query,
        "op6_embeddings": op6_embeddings.query,
        "op7_bpe": op7_bpe.query,
        "op8_toxicity": op8_toxicity.query,
        "op9_counts": op9_counts.query,
        "op10_pack": op10_pack.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard": op3_jaccard.ORACLE, "op4_substrings": op4_substrings.ORACLE, "op6_embeddings": op6_embeddings.ORACLE}
