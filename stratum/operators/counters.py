"""Counters of a run, gathered while it runs instead of by a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and its counters: ``rows`` and, for each condition, the rows for which it holds (null: it doesn't).

    ``observation.get`` has them after the first action; tasks that are run again aren't counted twice."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()]), o
