"""Quality rules with thresholds that follow the data.

Four statistics of each document, in thousandths, go into quantile sketches by language and source: a value counts by
its first DIGITS binary digits, so a sketch has some 500 counters for each doubling of the largest value, its error is
1/512 at most, whatever the range, and sketches merge by adding counts, with the same result in whatever order tasks
end. A group's bounds are its quartiles, widened by FENCE interquartile ranges and a slack, so that a group of good
documents loses none; a group of fewer than LEAST documents takes the bounds of all documents, whose sketch is the sum
of all groups'. A document stays if it passes the base rules and its statistics, as they are, lie within its group's
bounds.

Null and empty texts have no words and fail the base rules; a null language or source is a group like any other.
Repeated rows count and return as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, let, materialize, skew_safe_join, text_of

SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
FENCE, LEAST = 3, 20
#: Thousandths by which each bound is widened besides.
SLACK = {"symbols": 30, "dup_lines": 200, "repeats": 150, "word_length": 1500}
#: Statistics with a lower bound too.
TWO_SIDED = ("word_length",)
#: Binary digits of a value that its sketch keeps.
DIGITS = 10


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. The windows are sorted, so equal ones stand together."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    same = lambda a, i, j: F.get(a, i)["w"] == F.get(a, j)["w"]
    places = let(F.sort_array(windows), lambda a: F.transform(F.filter(F.transform(a, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(same(a, k, k - 1), F.lit(False)) | F.coalesce(same(a, k, k + 1), F.lit(False))).alias("r"))), lambda x: x["r"]), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(F.sort_array(places), start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return F.when(n < 4, F.lit(0)).otherwise(covered)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Base counts and the four statistics of every document, written once; the text is read in one pass."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)], text_of(text_col).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    both = let(lines, lambda a: F.struct(F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("d")))
    counted = let(_words(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    rows = base.select(
        "doc_id", *[f"g{i}" for i in range(len(groups))], counted.alias("w"), both.alias("l"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"), (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(
        "doc_id", *[f"g{i}" for i in range(len(groups))], F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("__lines"),
    )
    per = lambda a, b: F.coalesce(F.expr(f"{a} * 1000 div nullif({b}, 0)"), F.lit(0)).cast("long")
    rows = rows.withColumns({"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "__lines"), "repeats": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")})
    return materialize(rows, "quality")


def sketches(stats: DataFrame, n_groups: int = 2) -> DataFrame:
    """(group, what, value, n): counts by the first DIGITS digits of a value, merged by adding."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(k).alias("value")) for k in SLACK]))
    rows = stats.select(*[f"g{i}" for i in range(n_groups)], pairs.alias("p")).select(*[f"g{i}" for i in range(n_groups)], "p.what", "p.value")
    rest = f"greatest(0, length(bin(value)) - {DIGITS})"
    rows = rows.withColumn("value", F.expr(f"shiftleft(shiftright(value, {rest}), {rest})"))
    return rows.groupBy(*[f"g{i}" for i in range(n_groups)], "what", "value").agg(F.count(F.lit(1)).alias("n"))


def bounds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, docs, what_lo, what_hi): the smallest value that a quarter, and three quarters, do not exceed."""
    within = Window.partitionBy(*keys, "what")
    ranked = sketch.select(*keys, "what", "value", F.sum("n").over(within).alias("total"), F.sum("n").over(within.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value")))
    quartiles = ranked.groupBy(*keys, "what").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("docs"))
    lo, hi = F.col("q1") - FENCE * (F.col("q3") - F.col("q1")), F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))
    one = lambda k, c: F.max(F.when(F.col("what") == k, c))
    return quartiles.groupBy(*keys).agg(F.max("docs").alias("docs"), *[x for k, s in SLACK.items() for x in (one(k, lo - s).alias(f"{k}_lo"), one(k, hi + s).alias(f"{k}_hi"))])


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    stats = statistics(docs, id_col, text_col, groups)
    keys = [f"g{i}" for i in range(len(groups))]
    sketch = materialize(sketches(stats, len(groups)), "sketch")
    limits = [f"{k}_{e}" for k in SLACK for e in ("lo", "hi")]
    own = bounds(sketch, keys)
    every = bounds(sketch.groupBy("what", "value").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)), ["all"]).select(*limits).first()  # one row
    of_all = {x: F.lit(every[x] if every else None).cast("long") for x in limits}
    # nulls count as values of a group: JSON leaves them out, so no other value looks like them
    group = F.to_json(F.struct(*keys)).alias("__group")
    own = own.select(group, "docs", *[F.when(F.col("docs") >= LEAST, F.col(x)).otherwise(of_all[x]).alias(x) for x in limits])
    # a group may hold a third of all rows: its one row of bounds goes to them, not they to it
    rows = skew_safe_join(stats.select("*", group), own, "__group", "docs", stats.count())
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    inside = F.lit(True)
    for k in SLACK:
        inside = inside & (F.col(k) <= F.col(f"{k}_hi"))
        if k in TWO_SIDED:
            inside = inside & (F.col(k) >= F.col(f"{k}_lo"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))


def _sql() -> str:
    words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    per = lambda a, b, k: f"coalesce({a} * 1000 // nullif({b}, 0), 0)::BIGINT AS {k}"
    inside = " AND ".join(f"{k} <= {k}_hi" + (f" AND {k} >= {k}_lo" if k in TWO_SIDED else "") for k in SLACK)
    slack = " ".join(f"WHEN '{k}' THEN {s}" for k, s in SLACK.items())
    pivot = ", ".join(f"max(CASE WHEN what = '{k}' THEN lo END) AS {k}_lo, max(CASE WHEN what = '{k}' THEN hi END) AS {k}_hi" for k in SLACK)
    fence = lambda q: f"quantile_disc(value, {q})"
    limits = lambda keys: f"SELECT {keys}what, count(*) AS docs, {fence(0.25)} - {FENCE} * ({fence(0.75)} - {fence(0.25)}) - CASE what {slack} END AS lo, {fence(0.75)} + {FENCE} * ({fence(0.75)} - {fence(0.25)}) + CASE what {slack} END AS hi FROM v GROUP BY {keys}what"
    rest = lambda k: f"greatest(0, length(bin({k})) - {DIGITS})"
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS what, ({k} >> {rest(k)}) << {rest(k)} AS value FROM s" for k in SLACK)
    pick = ", ".join(f"CASE WHEN o.docs >= {LEAST} THEN o.{k}_{e} ELSE a.{k}_{e} END AS {k}_{e}" for k in SLACK for e in ("lo", "hi"))
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {words} AS ws FROM documents),
x AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM x) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
b AS (SELECT w.r, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w JOIN l USING (r) LEFT JOIN c USING (r)),
s AS (SELECT *, {per("n_symbols", "word_chars", "symbols")}, {per("n_dup_lines", "n_lines", "dup_lines")}, {per("n_repeat_words", "n_words", "repeats")}, {per("word_chars", "n_words", "word_length")} FROM b),
v AS ({values}),
own AS (SELECT lang, source, max(docs) AS docs, {pivot} FROM ({limits("lang, source, ")}) GROUP BY lang, source),
every AS (SELECT {pivot} FROM ({limits("")})),
k AS (SELECT o.lang, o.source, {pick} FROM own o, every a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND {inside} AS kept
FROM s JOIN k ON s.lang IS NOT DISTINCT FROM k.lang AND s.source IS NOT DISTINCT FROM k.source
"""


ORACLE_SQL = _sql()
