"""Joins of layers by text and span, and the sentence scan.

Layers meet on (text_id, from, to) or on text_id alone; windows are partitioned by text_id, so one exchange serves
several steps. A text is bounded by its length, so no window grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layers import tree_levels

SPAN = ["text_id", "from", "to"]
MORPHO = ["lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc", "norm", "orig", "phon", "trans"]


def sentence_scan(tokens: DataFrame, sentences: DataFrame, strict: bool = False) -> DataFrame:
    """``tokens`` with (sent, boundary): at most one border before a token, and after the last sentence one before each.

    Closed form of the scan: with c the number of sentence ends up to a token's start (unbounded once all are passed),
    sent = j + least(1, min over i <= j of (c_i - i)). strict: ends before a token's start, and none after the last."""
    marks = tokens.select(*tokens.columns, F.lit(1).alias("__k"), F.col("from").alias("__at")).unionByName(sentences.select("text_id", F.lit(2 if strict else 0).alias("__k"), F.col("to").alias("__at")), allowMissingColumns=True)
    w = Window.partitionBy("text_id").orderBy("__at", "__k", "tok_idx")
    ends = F.sum(F.when(F.col("__k") != 1, 1).otherwise(0))
    rows = marks.withColumns({"__c": ends.over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": ends.over(Window.partitionBy("text_id"))}).filter("__k = 1")
    by_token = Window.partitionBy("text_id").orderBy("tok_idx")
    passed = F.least(F.col("__c"), F.greatest(F.lit(0), F.col("__n") - 1)) if strict else F.when(F.col("__c") >= F.col("__n"), F.lit(1 << 40)).otherwise(F.col("__c"))
    low = F.min(passed - F.col("tok_idx")).over(by_token.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sent", (F.col("tok_idx") + F.least(F.lit(1), low)).cast("int"))
    return rows.withColumn("boundary", F.col("sent") != F.coalesce(F.lag("sent").over(by_token), F.lit(0))).drop("__k", "__at", "__c", "__n")


def token_ids(scanned: DataFrame) -> DataFrame:
    """``id``: the token's number in its sentence, from 1."""
    return scanned.withColumn("id", F.row_number().over(Window.partitionBy("text_id", "sent").orderBy("tok_idx")))


def last_readings(morpho: DataFrame, order: str = "span_idx") -> DataFrame:
    """One row per span: of repeated spans the last wins."""
    rest = [c for c in morpho.columns if c not in (*SPAN, "foundry", order)]
    return morpho.groupBy("text_id", "foundry", "from", "to").agg(F.max_by(F.struct(*rest), order).alias("m")).select("text_id", "foundry", "from", "to", "m.*")


def with_morpho(tokens: DataFrame, morpho: DataFrame) -> DataFrame:
    """Every token, with the annotation of exactly its span if there is one."""
    return tokens.join(morpho.drop("foundry"), SPAN, "left")


def merge_dependency(morpho: DataFrame, dependency: DataFrame) -> DataFrame:
    """Annotation and dependency of a span: either may lack. Dependency gives head and deprel."""
    return morpho.drop("foundry").join(dependency.drop("foundry"), SPAN, "full")


def fill_empty(first: DataFrame, second: DataFrame) -> DataFrame:
    """Annotations of a span from two readings of it: the second fills cells that are empty (null or ``_``) in the first."""
    cells = [c for c in first.columns if c not in SPAN]
    other = second.select(*SPAN, *[F.col(c).alias(f"__{c}") for c in cells if c in second.columns])
    given = lambda c: F.nullif(F.col(c), F.lit("_"))
    return first.join(other, SPAN, "full").select(*SPAN, *[F.coalesce(given(c), F.col(f"__{c}") if c in second.columns else F.lit(None), F.col(c)).alias(c) for c in cells])


def heads(tokens: DataFrame, dependency: DataFrame) -> DataFrame:
    """``head``: the 1-based number, in the whole text, of the token with the head's span; 0 if none has.

    A head that is a number already, in ``dependency``'s column ``head`` where it has one, passes through."""
    target = tokens.select("text_id", F.col("from").alias("head_from"), F.col("to").alias("head_to"), (F.col("tok_idx") + 1).alias("__of_span"))
    number = "head" in dependency.columns
    named = dependency.drop("foundry").withColumnRenamed("head", "__number") if number else dependency.drop("foundry")
    joined = tokens.join(named, SPAN, "left").join(target, ["text_id", "head_from", "head_to"], "left")
    of_span = F.when(F.col("deprel").isNotNull() | F.col("head_from").isNotNull(), F.coalesce("__of_span", F.lit(0)))
    head = F.when(F.col("head_from").isNull() & F.col("__number").isNotNull(), F.col("__number").try_cast("int")).otherwise(of_span) if number else of_span
    return joined.withColumn("head", head).drop("__of_span", *(["__number"] if number else []))


def edges(tokens: DataFrame, dependency: DataFrame) -> DataFrame:
    """(text_id, tok_idx, kind, other, deprel): ``out`` and ``in`` edges between tokens, and ``root`` where the head is 0 or
    its span is no token's and starts at 0. Other unresolved heads give nothing, nor do numbers beyond the text."""
    rows = heads(tokens, dependency).filter("deprel IS NOT NULL")
    n = tokens.groupBy("text_id").agg(F.count(F.lit(1)).alias("__n")) if "head" in dependency.columns else None
    rows = rows if n is None else rows.join(n, "text_id").filter(F.col("head") <= F.col("__n")).drop("__n")
    out = rows.filter("head > 0").select("text_id", "tok_idx", F.lit("out").alias("kind"), (F.col("head") - 1).alias("other"), "deprel")
    back = out.select("text_id", F.col("other").alias("tok_idx"), F.lit("in").alias("kind"), F.col("tok_idx").alias("other"), "deprel")
    at_zero = F.col("head_from") == 0 if n is None else F.coalesce(F.col("head_from") == 0, F.lit(True))
    root = rows.filter((F.col("head") == 0) & at_zero).select("text_id", "tok_idx", F.lit("root").alias("kind"), F.lit(-1).alias("other"), "deprel")
    return out.unionByName(back).unionByName(root)


def token_range(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """``spans`` (text_id, from, to, ...) with (token_from, token_to): the first token that starts in the span, else 0; one
    past the last that ends in it, else the number of tokens. Spans of texts without tokens are left out.

    Spans and tokens stand in one order of starts, in which the next token is carried back, and in one of ends, in
    which the last token is carried on: one exchange, two sorts, no pairs of spans and tokens."""
    token = F.struct("tok_idx", "from", "to")
    both = tokens.select("text_id", "from", "to", F.lit(1).alias("__k"), token.alias("__t"), F.lit(None).cast(spans.select(F.struct("*")).schema[0].dataType).alias("__s"))
    both = both.unionByName(spans.select("text_id", "from", "to", F.lit(0).alias("__k"), F.lit(None).cast(both.schema["__t"].dataType).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("__s")))
    of_text, upto = Window.partitionBy("text_id"), (Window.unboundedPreceding, 0)
    idx = F.col("__t.tok_idx")
    following = of_text.orderBy(F.desc("from"), F.desc("__k"), idx.desc()).rowsBetween(*upto)
    passed = of_text.orderBy("to", F.desc("__k"), idx).rowsBetween(*upto)
    rows = both.withColumn("__n", F.sum("__k").over(of_text)).withColumn("__first", F.last("__t", ignorenulls=True).over(following)).withColumn("__last", F.last("__t", ignorenulls=True).over(passed))
    first = F.when(F.col("__first.from") < F.col("to"), F.col("__first.tok_idx"))
    last = F.when(F.col("__last.to") > F.col("from"), F.col("__last.tok_idx") + 1)
    found = rows.filter("__k = 0 AND __n > 0").select("__s", F.coalesce(first, F.lit(0)).alias("token_from"), F.coalesce(last, F.col("__n").cast("int")).alias("token_to"))
    return found.select("__s.*", "token_from", "token_to")


def contained(sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sentences (text_id, sent_idx, from, to) with the first and last token that lie wholly within, if any. Tokens go to
    one sentence each: where sentences overlap, the later has only those that start behind the earlier's end."""
    before = F.max("to").over(Window.partitionBy("text_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1))
    spans = sentences.select("text_id", "sent_idx", F.greatest("from", F.coalesce(before, F.lit(0))).alias("from"), "to")
    token = F.struct("tok_idx", "from", "to")
    both = tokens.select("text_id", "from", "to", F.lit(1).alias("__k"), token.alias("__t"), F.lit(None).cast("int").alias("sent_idx")).unionByName(spans.withColumn("__k", F.lit(0)), allowMissingColumns=True)
    of_text, upto, idx = Window.partitionBy("text_id"), (Window.unboundedPreceding, 0), F.col("__t.tok_idx")
    rows = both.withColumn("__first", F.last("__t", ignorenulls=True).over(of_text.orderBy(F.desc("from"), F.desc("__k"), idx.desc()).rowsBetween(*upto)))
    rows = rows.withColumn("__last", F.last("__t", ignorenulls=True).over(of_text.orderBy("to", F.desc("__k"), idx).rowsBetween(*upto)))
    rows = rows.filter("__k = 0 AND __first.tok_idx <= __last.tok_idx")
    return rows.select("text_id", "sent_idx", F.col("__first.tok_idx").alias("first_tok"), F.col("__last.tok_idx").alias("last_tok"))


def relation_spans(annotated: DataFrame, sentences: DataFrame) -> DataFrame:
    """Relations of (text_id, tok_idx, from, to, head, deprel), with heads by number in the sentence, as spans: (text_id, tok_idx,
    from, to, sent, id, deprel, head_from, head_to).

    Sentences go on where a token starts behind the end of the one before. Head 0, or none, is the sentence's own span; a
    number counts on from the sentence's first token, also past its end, and a relation past the text's end is dropped."""
    numbered = token_ids(sentence_scan(annotated, sentences, strict=True))
    rows = numbered.withColumn("__goal", F.col("tok_idx") - F.col("id") + F.coalesce(F.col("head").try_cast("int"), F.lit(0)))
    target = annotated.select("text_id", F.col("tok_idx").alias("__goal"), F.col("from").alias("__f"), F.col("to").alias("__t"))
    w = Window.partitionBy("text_id").orderBy("from", "to")
    span = sentences.select("text_id", (F.row_number().over(w) - 1).alias("sent"), F.col("from").alias("__sf"), F.col("to").alias("__st"))
    kept = rows.filter("deprel IS NOT NULL AND deprel <> '_'").join(target, ["text_id", "__goal"], "left").join(span, ["text_id", "sent"], "left")
    root = F.coalesce(F.col("head").try_cast("int"), F.lit(0)) < 1
    found = kept.withColumns({"head_from": F.when(root, F.col("__sf")).otherwise(F.col("__f")), "head_to": F.when(root, F.col("__st")).otherwise(F.col("__t"))})
    return found.filter("head_from IS NOT NULL").select("text_id", "tok_idx", "from", "to", "sent", "id", "deprel", "head_from", "head_to")


def tree_depths(nodes: DataFrame, levels: int = 100) -> DataFrame:
    """(text_id, foundry, node_id, depth) of constituency nodes: roots, which no node refers to, have depth 0."""
    return tree_levels(nodes, levels).select("text_id", "foundry", "node_id", "depth")


def gaps(texts: DataFrame, expected: list[str]) -> DataFrame:
    """(text_id, missing, complete) of (text_id, foundry): which of the expected foundries a text lacks."""
    seen = texts.groupBy("text_id").agg(F.collect_set("foundry").alias("seen"))
    missing = F.sort_array(F.array_except(F.array(*[F.lit(x) for x in expected]), "seen"))
    return seen.select("text_id", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def ready(texts: DataFrame, *layers: DataFrame) -> DataFrame:
    """Texts that every layer knows."""
    for layer in layers:
        texts = texts.join(layer.select("text_id"), "text_id", "left_semi")
    return texts


def attribute_lines(attrs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(text_id, tok_idx, lines): attribute lines stand before the first token that starts at or after their offset."""
    marks = tokens.select("text_id", "tok_idx", F.col("from").alias("at"), F.lit(1).alias("k")).unionByName(attrs.select("text_id", "line", F.col("from").alias("at"), F.lit(0).alias("k"), F.col("pos")), allowMissingColumns=True)
    # backwards: a frame that only grows costs one step for each row
    w = Window.partitionBy("text_id").orderBy(F.desc("at"), F.desc("k"), F.desc("tok_idx")).rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("tok", F.last("tok_idx", ignorenulls=True).over(w)).filter("k = 0 AND tok IS NOT NULL")
    return placed.groupBy("text_id", F.col("tok").alias("tok_idx")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def fallback_sentences(structure: DataFrame) -> DataFrame:
    """Of a text's spans those named ``s``; without any, the first of posting, l, seg, u that it has."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(["s", "posting", "l", "seg", "u"]):
        rank = F.when(F.col("name") == name, i).otherwise(rank)
    rows = structure.withColumn("__r", rank).filter("__r IS NOT NULL")
    return rows.withColumn("__best", F.min("__r").over(Window.partitionBy("text_id"))).filter("__r = __best").drop("__r", "__best")
