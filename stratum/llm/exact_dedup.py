"""Exact dedup with a persistent digest index.

The index is a table bucketed and sorted by digest: a row per different text, with the document that stays, the batch
that brought it and its copies there, and a further row for the copies in each later batch. A batch is grouped by digest and
joined to the index by a sort-merge anti-join that moves only the new side; what the index lacks is appended, of what
it knows only the count. Texts are compared as they are.

Of equal texts in a batch the row with the largest id stays; of repeated rows (same id, same text) exactly one. A text
known from an earlier batch is dropped, also when the same batch is delivered twice: such copies count again. Null
counts as the empty text, a null id is smaller than any other. An empty table adds nothing. Other columns may have any
name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fresh_path, materialize, skew_safe_join, text_of

#: Digests to a bucket (about 128 MB of them), and the fewest and most buckets of an index.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 8, 50_000
SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, batch string, later boolean"
#: Stands for a null id in joins.
LOWEST = -(1 << 63)


class DigestIndex:
    """The index at ``path``, known to the catalog as ``table``; without a path it lives as long as the application.

    The number of buckets is fixed when the first batch comes: ``buckets``, or from that batch's rows and ``growth``,
    the number of such batches that the index is to hold."""

    def __init__(self, spark: SparkSession, path: str | None = None, table: str | None = None, buckets: int | None = None, growth: int = 1):
        self.spark, self.buckets, self.growth = spark, buckets, growth
        self.path = path or fresh_path(spark, "digest-index")
        self.table = table or f"digest_index_{uuid.uuid4().hex}"

    def create(self, rows: int) -> None:
        """Make the empty table, unless it is there."""
        if self.spark.catalog.tableExists(self.table):
            return
        n = self.buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows * self.growth // BUCKET_ROWS)))
        self.spark.sql(f"CREATE TABLE {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{self.path}'")

    def bucket_count(self) -> int:
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").filter("col_name = 'Num Buckets'").collect()  # one row
        return int(rows[0].data_type)

    def rows(self) -> DataFrame:
        """(digest, keep_id, keep_row, group_size, batch): one row per digest; its bucketing serves the aggregation."""
        own = F.when(~F.col("later"), F.struct("keep_id", "keep_row", "batch"))
        return self.spark.table(self.table).groupBy("digest").agg(F.first(own, ignorenulls=True).alias("k"), F.sum("group_size").alias("group_size")).select("digest", "k.keep_id", "k.keep_row", "group_size", "k.batch")

    def missing(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (a row per digest) whose digest the index lacks, by a sort-merge anti-join."""
        return groups.join(self.spark.table(self.table).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add what the index lacks, and the counts of what it knows. ``groups``, see ``groups_of``, is read twice."""
        later = groups.join(self.spark.table(self.table).filter("NOT later").select("digest").hint("merge"), "digest", "left_semi")
        columns = lambda df, is_later: df.select("digest", *([F.lit(None).cast("long").alias(c) for c in ("keep_id", "keep_row")] if is_later else ["keep_id", "keep_row"]), "group_size", F.lit(batch).alias("batch"), F.lit(is_later).alias("later"))
        # a table cannot be read and appended to at once
        new = materialize(columns(self.missing(groups), False).unionByName(columns(later, True)), "digests")
        n = self.bucket_count()
        new.repartition(n, "digest").write.bucketBy(n, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row): written once, so ``row`` tells repeated rows apart for good."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return materialize(narrow, "digest-rows")


def groups_of(rows: DataFrame) -> DataFrame:
    """A row per digest; counted before the shuffle, so a hot text costs a row per task."""
    top = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")


def _added(rows: DataFrame, index: DigestIndex) -> tuple[str, DataFrame]:
    """The batch's name and its groups, once they are in the index."""
    batch, groups = uuid.uuid4().hex, materialize(groups_of(rows), "digest-groups")
    index.append(groups, batch)
    return batch, groups


def _verdicts(rows: DataFrame, index: DigestIndex, batches: list[tuple[str, DataFrame]]) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of ``rows``, which came in ``batches``.

    The index is cut to their digests first, with the copies in these rows: those tell which digests are hot here."""
    n, added = rows.count(), None
    for _, groups in batches:
        own = groups.select("digest", F.col("group_size").alias("here"))
        added = own if added is None else added.unionByName(own)
    here = added.groupBy("digest").agg(F.sum("here").alias("here")) if len(batches) > 1 else added
    known = materialize(index.rows().join(here.hint("merge"), "digest"), "known-digests")
    joined = skew_safe_join(rows, known, "digest", "here", n)
    kept = (F.col("row") == F.col("keep_row")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("batch").isin([b for b, _ in batches])
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on every row of a batch, after adding it to ``index``. group_size: copies in all batches so far."""
    rows = digests(docs, id_col, text_col)
    index.create(rows.count())
    return _verdicts(rows, index, [_added(rows, index)])


def deduplicate_halves(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``deduplicate`` of a whole table, brought in two batches, larger ids first: what the second holds of the first
    goes by the anti-join, and the row that stays has the largest id of all."""
    rows = digests(docs, id_col, text_col)
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    index.create(n)
    upper = F.coalesce(F.col("doc_id") > (0 if low is None else low + (high - low) // 2), F.lit(False))
    return _verdicts(rows, index, [_added(rows.filter(upper), index), _added(rows.filter(~upper), index)])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; those known to ``index`` go.

    Rows meet by (digest, id), one pair of which the index names for each text: copies of a hot text go to different
    tasks. Repeated rows, which share both, become one in each task before they meet."""
    index = index or DigestIndex(docs.sparkSession)
    rows = digests(docs, id_col, text_col)
    index.create(rows.count())
    batch, _ = _added(rows, index)
    kept = index.rows().filter(F.col("batch") == batch).select(F.col("digest").alias("__digest"), F.coalesce("keep_id", F.lit(LOWEST)).alias("__key"))
    keyed = docs.withColumns({"__digest": F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)), "__key": F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))})
    return keyed.join(kept, ["__digest", "__key"], "left_semi").dropDuplicates(["__digest", "__key"]).drop("__digest", "__key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_halves(documents(spark, sf_dir), DigestIndex(spark))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
