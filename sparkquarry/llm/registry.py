"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sparkquarry.llm import chat_format, decontaminate, exact_dedup, filter_audit, hard_negatives, jaccard_join, language_id, line_dedup, lm_scoring, minhash_dedup, source_mix, substring_dedup, tables, toxicity

MODULES = {
    "op1_minhash_dedup": minhash_dedup,
    "op2_lm_scoring": lm_scoring,
    "op3_chat_format": chat_format,
    "op4_language_id": language_id,
    "op5_line_dedup": line_dedup,
    "op6_toxicity": toxicity,
    "op7_decontaminate": decontaminate,
    "op8_exact_dedup": exact_dedup,
    "op9_substring_dedup": substring_dedup,
    "op10_source_mix": source_mix,
    "op11_filter_audit": filter_audit,
    "op12_jaccard_join": jaccard_join,
    "op13_hard_negatives": hard_negatives,
}


def _settled(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written, and its intermediate tables deleted after that."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tables.scratch(spark):
            return tables.cut(MODULES[name].query(spark, sf_dir), keep=True)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _settled(name) for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: module.ORACLE for name, module in MODULES.items() if hasattr(module, "ORACLE")}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
