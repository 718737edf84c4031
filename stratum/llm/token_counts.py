"""Token counts: the exact histogram of encoded lengths answers totals, quantiles and truncated totals for any limit.

Null and empty texts have length 0 and are counted; repeated rows count as often as they occur; an empty table gives
an empty histogram. Only the text column is read, other columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, materialize, text_of
from .tokens import encoder, steps

TOKENIZER = "byte_bpe_50k.json"
#: Lengths to a block of the suffix sums: a window never sorts more rows than this.
BLOCK = 1024


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row ``n_tokens`` per document."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(0)
            for i, j in steps(texts):
                yield pa.RecordBatch.from_arrays([pa.array(enc.lengths(texts.slice(i, j - i)), pa.int64())], ["n_tokens"])

    return docs.select(text_of(text_col).alias("__text")).mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(n_tokens, n_docs): counted before the shuffle, so it moves a row for each length and task."""
    return lengths(docs, text_col, tokenizer).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, as context limit: documents and tokens of at least L, documents of at most L
    and their share (the quantile), all tokens, and the tokens left when every document is cut to L. ``hist`` is read
    twice, so it should be materialised."""
    rows = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("__b"))
    blocks = rows.groupBy("__b").agg(F.sum("n_docs").alias("__d"), F.sum("tokens").alias("__t"))
    # a row for BLOCK lengths: the longest document bounds their number
    later, every = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("__b", F.coalesce(F.sum("__d").over(later), F.lit(0)).alias("__dl"), F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__tl"), F.sum("__d").over(every).alias("docs_total"), F.sum("__t").over(every).alias("tokens_total"))
    here = Window.partitionBy("__b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, "__b").select("*", (F.sum("n_docs").over(here) + F.col("__dl")).alias("docs_at_least"), (F.sum("tokens").over(here) + F.col("__tl")).alias("tokens_at_least"))
    above = F.col("docs_at_least") - F.col("n_docs")
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("docs_total") - above).alias("docs_at_most"),
        ((F.col("docs_total") - above) / F.col("docs_total")).alias("quantile"), "tokens_total",
        (F.col("tokens_total") - (F.col("tokens_at_least") - F.col("tokens")) + F.col("n_tokens") * above).alias("truncated_total"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals at stated limits, whether or not a document has that length: the answer at L follows from the
    longest length at or under L and the documents above it."""
    spark = table.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    rows = table.groupBy().agg(*[F.max(F.when(F.col("n_tokens") <= x, F.struct("n_tokens", "truncated_total", (F.col("docs_at_least") - F.col("n_docs")).alias("above")))).alias(f"l{i}") for i, x in enumerate(limits)], F.max("docs_at_least").alias("docs"))
    value = F.lit(None).cast("long")
    for i, x in enumerate(limits):
        c = F.col(f"l{i}")
        value = F.when(F.col("context_limit") == x, F.when(c.isNull(), F.coalesce(F.col("docs"), F.lit(0)) * x).otherwise(c.truncated_total + (x - c.n_tokens) * c.above)).otherwise(value)
    return wanted.join(F.broadcast(rows)).select("context_limit", value.alias("truncated_total"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_table(materialize(histogram(documents(spark, sf_dir)), "lengths"))
