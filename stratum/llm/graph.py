"""Connected components by alternating stars: each round is two joins and aggregations, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, skew_safe_join


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node reachable; nodes without an edge to another aren't listed.

    edges: (a, b) longs, not null. The number of rounds grows with the logarithm of the longest chain; only two sums
    reach the driver in each. The centre of a large star is a hot key, so its edges meet its one row by broadcast. A
    round's edges go once the next are written."""
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before, total = None, edges.count()
    for _ in range(rounds):
        # large star: every larger neighbour of a node moves to the node's smallest
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0")
        large = skew_safe_join(both.filter("v > u"), low, "u", "n", total).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = materialize(large, "large-stars")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        small = skew_safe_join(large, low, "b", "n", total)
        small = small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old, large)
        # done when no node is both a root and someone's child, that is when every child has one root and no child
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before, total = state, state[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")
