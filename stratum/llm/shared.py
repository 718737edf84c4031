"""Helpers of the training-data operators: texts, and joins that stand a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, fresh_path, materialize, run_dir, shared_dir

__all__ = ["discard", "documents", "fresh_path", "hot_keys", "let", "materialize", "run_dir", "shared_dir", "skew_safe_join", "text_of"]

#: Most rows of a table of hot keys; a key is hot with 1/HOT_KEYS of all rows, so there can be no more.
HOT_KEYS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def hot_keys(counts: DataFrame, n: str, total: int) -> DataFrame:
    """Rows of ``counts`` (a row per key) whose key holds 1/HOT_KEYS of ``total`` rows: at most HOT_KEYS rows."""
    return counts.filter(F.col(n) >= max(1000, total // HOT_KEYS))


def skew_safe_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join where ``right`` has a row per key and ``n`` says how many of the ``total`` rows of ``left`` have it.

    Hot keys are joined by broadcast and so never meet in one task; the others by shuffle. ``n`` must count rows of
    ``left``: only then are there at most HOT_KEYS hot keys to broadcast. ``left`` and ``right`` should be
    materialised, they are read twice."""
    line = max(1000, total // HOT_KEYS)
    hot, cold = F.broadcast(right.filter(F.col(n) >= line)), right.filter(F.col(n) < line)
    hot_ids = F.broadcast(right.filter(F.col(n) >= line).select(key))
    return left.join(hot, key).unionByName(left.join(hot_ids, key, "left_anti").join(cold, key))
