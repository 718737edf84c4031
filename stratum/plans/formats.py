"""Text formats, one string per text or sentence, gathered in one aggregation by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell, surface_cell
from ..operators import rank


def _joined(key: str, piece: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), piece.alias("p")))), lambda x: x["p"]), "")


def now_lines(scanned: DataFrame, value: Column) -> DataFrame:
    """(text_id, line): ``@@id`` and tokens; a sentence border is ``<p>`` with a space more before it."""
    border = F.when(F.col("boundary") & (F.col("tok_idx") > 0), " <p> ").otherwise("")
    body = _joined("tok_idx", F.concat(border, value, F.lit(" ")))
    rows = scanned.groupBy("text_id").agg(F.concat(F.lit("@@"), F.first("text_id"), F.lit(" "), body).alias("line"))
    return rows.select("text_id", F.expr("left(line, length(line) - 1)").alias("line"))


def w2v_lines(scanned: DataFrame, value: Column, meta: Column | None = None) -> DataFrame:
    """(text_id, lines): a line per sentence. ``meta``, a column of joined metadata, stands before each line, but not
    where a sentence starts with the text's last token."""
    last = F.col("tok_idx") >= F.col("__n") - 1
    m = F.concat(meta, F.lit("\t")) if meta is not None else F.lit("")
    glue = F.when(F.col("tok_idx") == 0, m).when(F.col("boundary"), F.concat(F.lit("\n"), F.when(last, "").otherwise(m))).otherwise(" ")
    # over the texts as the scan left them: no exchange, no second scan
    return scanned.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("text_id"))).groupBy("text_id").agg(_joined("tok_idx", F.concat(glue, value)).alias("lines"))


def conllu_rows(tokens: DataFrame, compatible: bool = False, offsets: bool = False) -> DataFrame:
    """One row per token: the ten columns as strings. tokens: scanned, numbered, with annotation and heads; heads may lack.
    offsets: each token's span stands behind all else in the last column."""
    number = rank.certainties(F.col("misc"))
    several = F.size(F.split("xpos", r"\|")) > 1
    # a certainty alone, of a single reading, isn't shown
    misc = F.when(F.col("misc").isNull(), F.lit(None)).when(F.col("misc").rlike("^[0-9.]+$") & ~F.coalesce(several, F.lit(False)), F.lit(None)).otherwise(F.when(F.size(number) > 0, rank.sorted_misc(F.col("xpos"), F.col("misc"))).otherwise(F.col("misc")))
    xpos = F.when(F.col("misc").isNotNull(), rank.sorted_pos(F.col("xpos"), F.col("misc"))).otherwise(F.col("xpos"))
    lemma = F.when(F.col("misc").isNotNull(), rank.sorted_lemma(F.col("lemma"), F.col("xpos"), F.col("misc"))).when(F.col("lemma").contains("|"), F.array_join(F.array_distinct(F.split("lemma", r"\|")), "|")).otherwise(F.col("lemma"))
    upos = F.coalesce(F.col("upos"), xpos) if compatible else F.col("upos")
    if offsets:
        misc = F.concat_ws("|", F.nullif(misc, F.lit("_")), F.concat(F.lit("Offset="), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string")))
    head, deprel = (cell(F.col(c).cast("string")) if c in tokens.columns else F.lit("_") for c in ("head", "deprel"))
    # new names first: inside lambdas a name may mean a column of the same select
    made = [F.col("id").cast("string"), surface_cell(F.col("surface")), cell(lemma), cell(upos), cell(xpos), cell(F.col("feats")), head, deprel, F.lit("_"), cell(misc)]
    return tokens.select("text_id", "tok_idx", "sent", *[c.alias(f"__{i}") for i, c in enumerate(made)]).toDF("text_id", "tok_idx", "sent", *COLUMNS)


COLUMNS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def conllu_line(columns: int = 10) -> Column:
    """A token's line; 1: the surface alone."""
    return F.col("form") if columns == 1 else F.concat_ws("\t", *COLUMNS[: min(columns, 10)])


def offset_comments(scanned: DataFrame, sentences: DataFrame) -> DataFrame:
    """(text_id, sent, start_offsets, end_offsets): the sentence's first start and its own end, then each token's."""
    s = sentences.select("text_id", F.col("sent_idx").alias("sent"), F.col("to").alias("__to"))
    # the sentence's end comes to its tokens, so that a token beyond it is left out before the list is made
    w = scanned.select("text_id", "sent", "tok_idx", "from", "to").join(s, ["text_id", "sent"], "left")
    rows = w.groupBy("text_id", "sent").agg(F.sort_array(F.collect_list(F.when(F.col("__to").isNull() | (F.col("to") <= F.col("__to")), F.struct("tok_idx", "from", "to")))).alias("ts"), F.min("from").alias("first"), F.coalesce(F.max("__to"), F.max("to")).alias("end"))
    text = lambda k: F.array_join(F.transform("ts", lambda x: x[k].cast("string")), " ")
    return rows.select("text_id", "sent", F.concat_ws(" ", F.col("first").cast("string"), text("from")).alias("start_offsets"), F.concat_ws(" ", F.col("end").cast("string"), text("to")).alias("end_offsets"))


def conllu_texts(rows: DataFrame, comments: DataFrame, foundry: str, columns: int = 10, separator: str = "\n", metadata: DataFrame | None = None, trees: DataFrame | None = None, attributes: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(text_id, conllu): header, sentences with their comments, a blank line after each.

    metadata: (text_id, values), tab-joined before the first sentence's tokens; trees: (text_id, sent, brackets) before each;
    attributes: (text_id, tok_idx, lines) before a token; texts: those without tokens have the header alone."""
    line = F.concat(conllu_line(columns), F.lit(separator))
    if attributes is not None:
        rows = rows.join(attributes.select("text_id", "tok_idx", F.col("lines").alias("__lines")), ["text_id", "tok_idx"], "left")
        line = F.concat(F.coalesce(F.concat("__lines", F.lit("\n")), F.lit("")), line)
    whole = rows.groupBy("text_id", "sent").agg(_joined("tok_idx", line).alias("body")).join(comments, ["text_id", "sent"])
    before = [F.lit("# start_offsets = "), F.col("start_offsets"), F.lit("\n# end_offsets = "), F.col("end_offsets"), F.lit("\n")]
    if trees is not None:
        whole = whole.join(trees.select("text_id", "sent", "brackets"), ["text_id", "sent"], "left")
        before.append(F.coalesce(F.concat(F.lit("# constituency = "), F.when(F.trim("brackets") != "", F.col("brackets")), F.lit("\n")), F.lit("")))
    if metadata is not None:
        whole = whole.join(metadata.select("text_id", F.array_join("values", "\t").alias("__meta")), "text_id", "left")
        before.append(F.when((F.col("sent") == 0) & F.col("__meta").isNotNull(), F.concat(F.lit("# metadata="), F.col("__meta"), F.lit("\n"))).otherwise(""))
    whole = whole.withColumn("part", F.concat(*before, F.col("body"), F.lit("\n")))
    layer = "base/tokens.xml" if foundry == "base" else f"{foundry}/morpho.xml"
    head = F.concat(F.lit(f"# foundry = {foundry}\n# filename = "), F.translate("text_id", "_.", "//"), F.lit(f"/{layer}\n# text_id = "), F.col("text_id"), F.lit("\n"))
    out = whole.groupBy("text_id").agg(_joined("sent", F.col("part")).alias("body"))
    if texts is not None:
        out = texts.select("text_id").join(out, "text_id", "left")
    return out.select("text_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("conllu"))


def morpho_xml(rows: DataFrame) -> DataFrame:
    """(text_id, xml): a span per token, an ``fs`` per alternative reading."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    f = lambda name, v: F.when(v.isNotNull() & (v != "_"), F.concat(F.lit(f'<f name="{name}">'), esc(v), F.lit("</f>"))).otherwise("")
    alt = lambda c, i: F.get(F.split(c, r"\|"), i)
    certainty = lambda i: F.when(alt(F.col("misc"), i).try_cast("double").isNotNull(), alt(F.col("misc"), i))
    one = lambda i: F.concat(F.lit('<fs type="lex"><f name="lex"><fs>'), f("lemma", alt(F.col("lemma"), i)), f("upos", alt(F.col("upos"), i)), f("pos", alt(F.col("xpos"), i)), f("msd", F.when(i == 0, F.col("feats"))), f("certainty", certainty(i)), F.lit("</fs></f></fs>"))
    n = F.greatest(F.lit(1), F.size(F.split(F.coalesce("xpos", F.lit("_")), r"\|")))
    span = F.concat(F.lit('<span id="t_'), F.col("tok_idx").cast("string"), F.lit('" from="'), F.col("from").cast("string"), F.lit('" to="'), F.col("to").cast("string"), F.lit('">'), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), ""), F.lit("</span>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<layer docid="'), F.col("text_id"), F.lit('"><spanList>'))
    return rows.groupBy("text_id").agg(_joined("tok_idx", span).alias("body")).select("text_id", F.concat(head, F.col("body"), F.lit("</spanList></layer>")).alias("xml"))


def dependency_xml(rows: DataFrame) -> DataFrame:
    """(text_id, xml) of rows (tok_idx, from, to, sent, id, deprel, head_from, head_to); tokens without a relation are skipped."""
    span = F.concat(
        F.lit('<span id="s'), (F.col("sent") + 1).cast("string"), F.lit("_n"), F.col("id").cast("string"), F.lit('" from="'), F.col("from").cast("string"), F.lit('" to="'), F.col("to").cast("string"), F.lit('"><rel label="'), F.col("deprel"),
        F.lit('"><span from="'), F.col("head_from").cast("string"), F.lit('" to="'), F.col("head_to").cast("string"), F.lit('"/></rel></span>'),
    )
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<layer docid="'), F.col("text_id"), F.lit('"><spanList>'))
    kept = rows.filter("deprel IS NOT NULL AND deprel <> '_' AND head_from IS NOT NULL")
    return kept.groupBy("text_id").agg(_joined("tok_idx", span).alias("body")).select("text_id", F.concat(head, F.col("body"), F.lit("</spanList></layer>")).alias("xml"))


def constituency_xml(nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(text_id, xml) of rows (text_id, span_idx, node_id, label, from, to, children of (kind, id)): a span per node with a
    relation to each child. With ``texts``, those without a tree get the XML declaration alone."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    at = lambda c: F.when(c["kind"] == "node", F.concat(F.lit('target="'), esc(c["id"]))).otherwise(F.concat(F.lit('uri="morpho.xml#'), esc(c["id"])))
    rels = F.array_join(F.transform(F.coalesce("children", F.array()), lambda c: F.concat(F.lit('<rel label="dominates" '), at(c), F.lit('"/>'))), "")
    span = F.concat(F.lit('<span id="'), esc(F.col("node_id")), F.lit('" from="'), F.col("from").cast("string"), F.lit('" to="'), F.col("to").cast("string"), F.lit('"><fs type="node"><f name="const">'), esc(F.coalesce("label", F.lit(""))), F.lit("</f></fs>"), rels, F.lit("</span>"))
    first = '<?xml version="1.0" encoding="UTF-8"?>\n'
    layer = nodes.groupBy("text_id").agg(_joined("span_idx", span).alias("body")).select("text_id", F.concat(F.lit(first + '<layer docid="'), esc(F.col("text_id")), F.lit('"><spanList>'), F.col("body"), F.lit("</spanList></layer>")).alias("xml"))
    return layer if texts is None else texts.select("text_id").join(layer, "text_id", "left").select("text_id", F.coalesce("xml", F.lit(first)).alias("xml"))
