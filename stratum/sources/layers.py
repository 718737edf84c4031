"""Parsers of stand-off XML layers, as ``from_xml`` and explode. Input: (text_id, foundry, layer, xml)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

OPTIONS = {"ignoreSurroundingSpaces": "false", "attributePrefix": "_", "valueTag": "_VALUE"}
_F = "array<struct<_name:string,_VALUE:string,symbol:struct<_value:string>>>"
SPANS = "_docid string, spanList struct<span:array<struct<_id:string,_from:string,_to:string,_l:string,_type:string,rel:array<struct<_label:string,_target:string,_uri:string,span:struct<_from:string,_to:string>>>,fs:array<struct<_type:string,f:array<struct<_name:string,_VALUE:string,fs:array<struct<f:" + _F + ">>>>>>>>>"


def without_comments(xml: Column) -> Column:
    """XML without comments, also those with a double hyphen inside."""
    return F.regexp_replace(xml, "(?s)<!--.*?-->", "")


def _spans(rows: DataFrame) -> DataFrame:
    parsed = F.from_xml(without_comments(F.col("xml")), SPANS, OPTIONS)
    out = rows.select("text_id", "foundry", F.posexplode(parsed["spanList"]["span"]).alias("span_idx", "s"))
    out = out.select("text_id", "foundry", "span_idx", F.col("s._from").try_cast("int").alias("from"), F.col("s._to").try_cast("int").alias("to"), "s")
    return out.filter("`from` IS NOT NULL AND `to` IS NOT NULL")


def data(rows: DataFrame) -> DataFrame:
    """(text_id, docid, text); white space is kept."""
    parsed = F.from_xml(without_comments(F.col("xml")), "_docid string, text string", OPTIONS)
    return rows.select("text_id", parsed["_docid"].alias("docid"), parsed["text"].alias("text"))


def tokens(rows: DataFrame) -> DataFrame:
    """(text_id, tok_idx, from, to); spans whose offsets aren't numbers are skipped."""
    s = _spans(rows)
    return s.groupBy("text_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("span_idx", "from", "to"))), lambda x, i: F.struct(i.alias("tok_idx"), x["from"].alias("from"), x["to"].alias("to"))).alias("ts")).select("text_id", F.inline("ts"))


def sentences(rows: DataFrame) -> DataFrame:
    """(text_id, layer, from, to, depth, attributes) of sentence layers: the spans of each foundry, once for a text."""
    one = rows.dropDuplicates(["text_id", "foundry"])
    none = F.lit(None).cast("map<string,string>")
    return _spans(one).select("text_id", F.concat("foundry", F.lit("/s:s")).alias("layer"), "from", "to", F.lit(0).alias("depth"), none.alias("attributes"))


def tree_levels(nodes: DataFrame, levels: int = 100) -> DataFrame:
    """``nodes`` with ``depth``. Levels are found one after another, each by a semi-join with the children of the one before."""
    at = ["text_id", "foundry", "node_id"]
    children = lambda df: df.select("text_id", "foundry", F.explode(F.filter("children", lambda c: c["kind"] == "node")).alias("c")).select("text_id", "foundry", F.col("c.id").alias("node_id")).distinct()
    level, out = nodes.join(children(nodes), at, "left_anti"), None
    for depth in range(levels):
        level = materialize(level, "tree-level")
        found = level.withColumn("depth", F.lit(depth))
        out = found if out is None else out.unionByName(found)
        level_children = children(level)
        if level_children.isEmpty():
            return out
        level = nodes.join(level_children, at, "left_semi")
    raise RuntimeError(f"trees of over {levels} levels")


def constituency_spans(nodes: DataFrame, levels: int = 100) -> DataFrame:
    """(text_id, layer, from, to, depth, attributes) of trees: a span ``F/c:label`` for each node, by its depth in its tree."""
    none = F.lit(None).cast("map<string,string>")
    return tree_levels(nodes, levels).select("text_id", F.concat("foundry", F.lit("/c:"), F.coalesce("label", F.lit(""))).alias("layer"), "from", "to", "depth", none.alias("attributes"))


def attributes(structure: DataFrame, pattern: str) -> DataFrame:
    """(text_id, from, pos, line) of ``structure`` spans: a comment for each attribute whose ``element/attribute`` the
    pattern matches as a whole."""
    rows = structure.withColumn("pos", F.row_number().over(Window.partitionBy("text_id").orderBy("from", F.desc("to"), "depth", "name")))
    each = rows.select("text_id", "from", "pos", "name", F.posexplode(F.map_entries("attributes")).alias("i", "a"))
    key = F.concat(F.trim("name"), F.lit("/"), F.col("a.key"))
    return each.filter(key.rlike(f"^(?:{pattern})$")).select("text_id", "from", F.struct("pos", "i").alias("pos"), F.concat(F.lit("# "), key, F.lit(" = "), F.col("a.value")).alias("line"))


def structure(rows: DataFrame) -> DataFrame:
    """(text_id, name, from, to, depth, attributes)."""
    feats = F.flatten(F.transform("s.fs", lambda x: x["f"]))
    name = F.get(F.filter(feats, lambda x: x["_name"] == "name"), F.lit(0))["_VALUE"]
    attrs = F.flatten(F.transform(F.filter(feats, lambda x: x["_name"] == "attr"), lambda x: F.flatten(F.transform(x["fs"], lambda y: y["f"]))))
    pairs = F.map_from_entries(F.transform(F.coalesce(attrs, F.array().cast(_F)), lambda x: F.struct(x["_name"].alias("k"), F.coalesce(x["_VALUE"], F.lit("")).alias("v"))))
    return _spans(rows).select("text_id", name.alias("name"), "from", "to", F.coalesce(F.col("s._l").try_cast("int"), F.lit(0)).alias("depth"), pairs.alias("attributes"))


#: Names of features and the column that each fills; fixed values.
FEATURES = {"lemma": "lemma", "upos": "upos", "xpos": "xpos", "ctag": "xpos", "pos": "xpos", "feats": "feats", "msd": "feats", "norm": "norm", "orig": "orig", "phon": "phon", "trans": "trans", "certainty": "misc"}


def morpho(rows: DataFrame) -> DataFrame:
    """(text_id, foundry, span_idx, from, to, lemma, upos, ...): alternatives are joined by |; an unknown lemma or tag is --."""
    s = _spans(rows)
    outer = F.flatten(F.transform(F.filter("s.fs", lambda x: F.coalesce(x["_type"], F.lit("")) != "alt"), lambda x: x["f"]))
    inner = F.flatten(F.transform(outer, lambda x: F.flatten(F.transform(x["fs"], lambda y: y["f"]))))

    # of a span without features the symbol of its type, where it has one
    symbol = F.nullif(F.trim(F.get(F.filter(inner, lambda x: (x["_name"] == "type") & x["symbol"].isNotNull()), F.lit(0))["symbol"]["_value"]), F.lit(""))

    def cells(column: str) -> Column:
        names = [k for k, v in FEATURES.items() if v == column]
        value = lambda x: F.when(x["_VALUE"].isin("UNKNOWN", "<unknown>"), "--").otherwise(x["_VALUE"]) if column in ("lemma", "xpos") else x["_VALUE"]
        found = F.transform(F.filter(inner, lambda x: x["_name"].isin(*names) & x["_VALUE"].isNotNull()), value)
        out = F.nullif(F.array_join(found, "|"), F.lit(""))
        return F.coalesce(out, symbol).alias(column) if column == "feats" else out.alias(column)

    return s.select("text_id", "foundry", "span_idx", "from", "to", *[cells(c) for c in dict.fromkeys(FEATURES.values())])


def dependency(rows: DataFrame) -> DataFrame:
    rel = F.get(F.col("s.rel"), F.lit(0))
    return _spans(rows).select("text_id", "foundry", "from", "to", rel["_label"].alias("deprel"), rel["span"]["_from"].try_cast("int").alias("head_from"), rel["span"]["_to"].try_cast("int").alias("head_to")).filter("deprel IS NOT NULL")


def constituency(rows: DataFrame) -> DataFrame:
    """(text_id, foundry, span_idx, node_id, label, from, to, children of (kind, id))."""
    feats = F.flatten(F.transform("s.fs", lambda x: x["f"]))
    label = F.get(F.filter(feats, lambda x: x["_name"] == "const"), F.lit(0))["_VALUE"]
    kids = F.transform(F.filter("s.rel", lambda r: r["_label"] == "dominates"), lambda r: F.when(r["_target"].isNotNull(), F.struct(F.lit("node").alias("kind"), r["_target"].alias("id"))).otherwise(F.struct(F.lit("morpho").alias("kind"), F.substring_index(r["_uri"], "#", -1).alias("id"))))
    return _spans(rows).select("text_id", "foundry", "span_idx", F.col("s._id").alias("node_id"), label.alias("label"), "from", "to", kids.alias("children"))


def standoff(rows: DataFrame) -> DataFrame:
    """(docid, key, type, pos, n, cert, target, title): the entries of metadata layers of any type, one row per text and
    entry. Layers without a key, texts without a target and blank targets give no row; a layer without a type is a classification."""
    ref = "struct<_target:string,_VALUE:string>"
    schema = f"metadataLayer array<struct<`_xml:id`:string,_key:string,_type:string,textRef:array<struct<_target:string,catRef:array<struct<_n:string,_cert:string,_target:string>>,ref:array<{ref}>>>>>"
    given = lambda c: F.when(F.trim(c) != "", c)
    bare = lambda c: F.regexp_replace(c, "^#", "")
    layer = rows.select(F.explode(F.from_xml(without_comments(F.col("xml")), schema, OPTIONS)["metadataLayer"]).alias("m"))
    each = layer.select(F.coalesce(given(F.col("m")["_xml:id"]), given(F.col("m._key"))).alias("key"), F.coalesce(given(F.col("m._type")), F.lit("classification")).alias("type"), F.explode("m.textRef").alias("t"))
    none = F.lit(None).cast("string")
    classes = F.transform("t.catRef", lambda c, i: F.struct(i.alias("pos"), c["_n"].try_cast("int").alias("n"), c["_cert"].try_cast("double").alias("cert"), bare(c["_target"]).alias("target"), none.alias("title")))
    # of a text's links the first counts, even where it is blank
    links = F.transform(F.slice("t.ref", 1, 1), lambda r, i: F.struct(i.alias("pos"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("double").alias("cert"), r["_target"].alias("target"), F.trim(r["_VALUE"]).alias("title")))
    entries = each.select(bare(F.col("t._target")).alias("docid"), "key", "type", F.explode(F.when(F.col("type") == "classification", classes).when(F.col("type") == "links", links)).alias("e"))
    return entries.filter("trim(docid) <> '' AND key IS NOT NULL AND trim(e.target) <> ''").select("docid", "key", "type", "e.*")
