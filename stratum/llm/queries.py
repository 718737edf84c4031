"""Queries opN_<name> of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, exact_dedup, packing, pii, quality_rules, simhash, suffix_dedup, token_counts, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_token_counts": token_counts.query,
    "op3_quality_rules": quality_rules.query,
    "op4_token_files": token_files.query,
    "op5_bpe": bpe.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_simhash": simhash.query,
    "op8_quality_classifier": classifier.query,
    "op9_packing": packing.query,
    "op10_exact_dedup": exact_dedup.query,
}
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
