"""CoNLL-U as layers, and a streaming-friendly parse of whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tokens of files under ``path``; see ``parse``."""
    return parse(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")), **options)


def parse(files: DataFrame, foundry: str | None = None, strict: bool = True) -> DataFrame:
    """(text_id, foundry, sent_idx, id, form, lemma, ..., misc, from, to) of (file, content).

    A text starts at ``# text_id``; ``# foundry`` holds until the next one, and ``foundry`` overrides it. Only integer
    ids with ten cells count. The n-th id of a sentence has the (n+1)-th number of the offset comments. strict: a token
    without text, foundry or offsets is an error; else it is left out."""
    lines = files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # a foundry comment stands before the text_id that it belongs to
    tag = lambda k: F.when(F.col("line").startswith(f"# {k} = "), F.trim(F.substring("line", len(k) + 6, (1 << 31) - 1)))
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    counter = lambda k: F.sum(F.when(F.col("line").startswith(f"# {k} = "), 1).otherwise(0)).over(w)
    rows = lines.select(
        "file", "pos", "line", last(tag("text_id")).alias("text_id"), (F.lit(foundry) if foundry else last(tag("foundry"))).alias("foundry"),
        counter("start_offsets").alias("block"), counter("end_offsets").alias("end_block"), tag("start_offsets").alias("starts"), tag("end_offsets").alias("ends"),
    )
    # a sentence's tokens meet its comments in one group, in the exchange by file: its numbers are split once, and found by place
    rows = rows.withColumn("part", F.greatest("block", "end_block"))
    is_token = F.col("line").rlike(r"^[0-9]+\t") & (F.size(F.split("line", "\t")) >= 10)
    numbers = lambda c: F.transform(F.split(c, r"\s+"), lambda x: x.try_cast("int"))
    comments = lambda block, c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(block).alias("b"), numbers(F.col(c)).alias("v"))))
    held = rows.groupBy("file", "part").agg(F.collect_list(F.when(is_token, F.struct("pos", "line", "text_id", "foundry", "block", "end_block"))).alias("ts"), comments("block", "starts").alias("ss"), comments("end_block", "ends").alias("es"))
    number = lambda list_, block, i: F.get(F.get(F.filter(list_, lambda x: x["b"] == block), F.lit(0))["v"], i)

    def placed(t):
        i = F.substring_index(t["line"], "\t", 1).cast("int")
        return F.struct(t["line"].alias("line"), t["text_id"].alias("text_id"), t["foundry"].alias("foundry"), t["block"].alias("block"), i.alias("id"), number("ss", t["block"], i).alias("from"), number("es", t["end_block"], i).alias("to"))

    tokens = held.select("file", F.inline(F.transform("ts", placed)))
    cells = F.split("line", "\t")
    empty = lambda c: F.when(c != "_", c)
    sent = F.dense_rank().over(Window.partitionBy("file", "text_id").orderBy("block")) - 1
    out = tokens.select("text_id", "foundry", sent.alias("sent_idx"), "id", *[(cells[i + 1] if c == "form" else empty(cells[i + 1])).alias(c) for i, c in enumerate(COLUMNS)], "from", "to")
    known = F.col("text_id").isNotNull() & F.col("foundry").isNotNull() & F.col("from").isNotNull() & F.col("to").isNotNull()
    if strict:
        return out.withColumn("text_id", F.when(known, F.col("text_id")).otherwise(F.raise_error(F.lit("token without text_id, foundry or offsets")).cast("string")))
    return out.filter(known)


def split_foundries(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotation, dependency): of a compound foundry a-b the first owns the annotation, the second the relations.
    Heads become spans: ids are of the sentence, 0 the sentence's own span."""
    two = F.split("foundry", "-")
    head = parsed.select("text_id", "sent_idx", F.col("id").cast("string").alias("head"), F.col("from").alias("head_from"), F.col("to").alias("head_to"))
    whole = parsed.groupBy("text_id", "sent_idx").agg(F.min("from").alias("s_from"), F.max("to").alias("s_to"))
    morpho = parsed.select("text_id", two[0].alias("foundry"), "from", "to", "lemma", "upos", "xpos", "feats", "misc")
    rows = parsed.filter("head IS NOT NULL AND deprel IS NOT NULL").join(head, ["text_id", "sent_idx", "head"], "left").join(whole, ["text_id", "sent_idx"])
    dependency = rows.filter("head = '0' OR head_from IS NOT NULL").select("text_id", F.coalesce(F.get(two, F.lit(1)), two[0]).alias("foundry"), "from", "to", "deprel", F.coalesce("head_from", "s_from").alias("head_from"), F.coalesce("head_to", "s_to").alias("head_to"))
    return morpho, dependency
