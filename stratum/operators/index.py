"""Index documents: token streams, layer summaries, fields, and their update."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import data_uri, encode_form, escape_attribute, escape_json, escape_value, foundry_prefix, is_word, link_uri, sigle
from . import align, rank
from .meta import LEGACY_NAMES, legacy_name

#: Older names of fields; an update under either name is of the same field.
LEGACY_ALIASES = {old: new for new, old in LEGACY_NAMES.items()}
#: Classes of a token's annotations in stream order.
CLASSES = ["counts", "spans", "offsets", "lower", "nonword", "inverse", "foundry", "surface"]


#: Foundries of the text's own structure: their spans aren't advertised as an annotation.
STRUCTURE = ("base", "dereko")
#: Parts of structure that a text with sentences is said to have; fixed values.
STRUCTURE_PARTS = ["dereko", "dereko/structure", "dereko/structure/base-sentences-paragraphs-pagebreaks"]
#: Inline layers beside lemma and part of speech.
EXTRA = ("norm", "orig", "phon", "trans")


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "_")


def layer_infos(morpho: DataFrame, dependency: DataFrame) -> DataFrame:
    """(text_id, rank, layer) of annotations: a layer is listed if any cell of it is given. Part of speech is one of
    either kind; relations need a head and a label."""
    p = foundry_prefix(F.col("foundry"))
    has = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    extra = [c for c in EXTRA if c in morpho.columns]
    kinds = {"l": _given("lemma"), "p": _given("xpos") | _given("upos"), "m": _given("feats"), "u": _given("upos") & (F.col("foundry") != "tree_tagger"), **{c: _given(c) for c in extra}}
    m = morpho.groupBy("text_id", p.alias("prefix")).agg(*[has(F.coalesce(c, F.lit(False))).alias(f"__{k}") for k, c in kinds.items()])
    named = F.filter(F.array(*[F.when(F.col(f"__{k}"), F.lit(f"{k}=tokens")) for k in kinds]), lambda x: x.isNotNull())
    rows = m.select("text_id", "prefix", F.explode(named).alias("layer"))
    headed = F.col("head_from").isNotNull() | _given("head") if "head" in dependency.columns else F.col("head_from").isNotNull()
    d = dependency.filter(_given("deprel") & headed).select("text_id", p.alias("prefix"), F.lit("d=rels").alias("layer")).distinct()
    return rows.unionByName(d).filter("prefix IS NOT NULL").select("text_id", F.lit(4).alias("rank"), F.concat_ws("/", "prefix", "layer").alias("layer")).distinct()


def structure_layers(sentences: DataFrame, spans: DataFrame, nonword: DataFrame | None = None) -> DataFrame:
    """(text_id, rank, layer) of structure: texts with sentences, texts (``nonword``) whose other tokens are kept, and
    foundries with sentence (``F/s:``) or constituency (``F/c:``) spans of their own."""
    own = sentences.select("text_id").distinct().select("text_id", F.lit(0).alias("rank"), F.lit("dereko/s=spans").alias("layer"))
    if nonword is not None:
        own = own.unionByName(nonword.select("text_id").distinct().select("text_id", F.lit(1).alias("rank"), F.lit("base/p=tokens").alias("layer")))
    f, kind = F.substring_index("layer", "/", 1), F.substring(F.substring_index("layer", "/", -1), 1, 2)
    foreign = spans.filter(~f.isin(*STRUCTURE)).select("text_id", F.when(kind == "s:", 2).when(kind == "c:", 3).alias("rank"), F.concat(f, F.when(kind == "s:", "/s=spans").otherwise("/c=spans")).alias("layer"))
    return own.unionByName(foreign.filter("rank IS NOT NULL").distinct())


def parse_layers(summary: DataFrame) -> DataFrame:
    """(text_id, rank, layer) of (text_id, layer_infos)."""
    rows = summary.select("text_id", F.explode(F.filter(F.split("layer_infos", " "), lambda x: x != "")).alias("layer"))
    rank = F.when(F.col("layer") == "dereko/s=spans", 0).when(F.col("layer") == "base/p=tokens", 1).when(F.col("layer").endswith("/s=spans"), 2).when(F.col("layer").endswith("/c=spans"), 3).otherwise(4)
    return rows.select("text_id", rank.alias("rank"), "layer")


def layer_summary(layers: DataFrame) -> DataFrame:
    """(text_id, layer_infos, foundries) of (text_id, rank, layer): the layers in order, and each foundry with its kinds."""
    full = F.split("layer", "/")
    name = F.when(full[0] == "tt", "treetagger").otherwise(full[0])
    at = lambda a, b, c, word: F.struct(F.lit(a).alias("a"), b.alias("b"), F.lit(c).alias("c"), word.alias("word"))
    none = F.lit("")
    own = F.array(*[at(0, none, i, F.lit(w)) for i, w in enumerate(STRUCTURE_PARTS)])
    foreign = F.array(at(1, full[0], 0, full[0]), F.when(F.col("rank") == 2, at(1, full[0], 1, F.concat(full[0], F.lit("/sentences")))).otherwise(at(1, full[0], 2, F.concat(full[0], F.lit("/structure")))))
    # the foundry of an annotation is named even if its structure has named it
    kind = F.when(full[1].startswith("d="), at(2, full[0], 1, F.concat(name, F.lit("/dependency")))).otherwise(at(2, full[0], 2, F.concat(name, F.lit("/morpho"))))
    words = F.when(F.col("rank") == 0, own).when(F.col("rank").isin(2, 3), foreign).when(F.col("rank") == 4, F.array(at(2, full[0], 0, name), kind))
    rows = layers.select("text_id", "rank", "layer", words.alias("words"))
    infos = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("rank", "layer"))), lambda x: x["layer"]), " ")
    each = F.array_join(F.transform(F.sort_array(F.array_distinct(F.flatten(F.collect_set("words")))), lambda x: x["word"]), " ")
    return rows.groupBy("text_id").agg(infos.alias("layer_infos"), each.alias("foundries"))


def base_spans(tokens: DataFrame, sentences: DataFrame, structure: DataFrame | None = None, text_ends: DataFrame | None = None) -> DataFrame:
    """(text_id, layer, from, to, depth, token_from, token_to, attributes): the text, its paragraphs and sentences, and the
    structure's own spans with their token ranges. structure: (text_id, name or layer, from, to, depth, attributes);
    text_ends: (text_id, to), where the text ends further than the last kept token."""
    none = F.lit(None).cast("map<string,string>")
    n = tokens.groupBy("text_id").agg(F.max("to").alias("to"), F.count(F.lit(1)).cast("int").alias("token_to"))
    n = n if text_ends is None else n.drop("to").join(text_ends.select("text_id", "to"), "text_id")
    whole = n.select("text_id", F.lit("base/s:t").alias("layer"), F.lit(0).alias("from"), "to", F.lit(0).alias("depth"), F.lit(0).alias("token_from"), "token_to", none.alias("attributes"))
    idx = tokens.select("text_id", "tok_idx", "from", "to")
    inside = align.contained(sentences, tokens)
    first = idx.select("text_id", F.col("tok_idx").alias("first_tok"), "from")
    last = idx.select("text_id", F.col("tok_idx").alias("last_tok"), "to")
    sents = inside.join(first, ["text_id", "first_tok"]).join(last, ["text_id", "last_tok"])
    out = whole.unionByName(sents.select("text_id", F.lit("base/s:s").alias("layer"), "from", "to", F.lit(2).alias("depth"), F.col("first_tok").alias("token_from"), (F.col("last_tok") + 1).alias("token_to"), none.alias("attributes")))
    if structure is None:
        return out
    layer = F.col("layer") if "layer" in structure.columns else F.concat(F.lit("dereko/s:"), F.col("name"))
    given = structure.select("text_id", layer.alias("layer"), "from", "to", "depth", "attributes")
    own = given.unionByName(given.filter(F.col("layer").endswith(":p")).withColumns({"layer": F.lit("base/s:p"), "depth": F.lit(1), "attributes": none}))
    return out.unionByName(align.token_range(own, tokens))


def _span_order(depth: Column, layer: Column, start: Column) -> Column:
    """Deeper spans first, then by layer and start."""
    return F.concat_ws(":", F.lpad((F.lit(999_999) - depth).cast("string"), 6, "0"), layer, F.lpad(start.cast("string"), 10, "0"))


#: An annotation: its class (a number of CLASSES), the foundry it belongs to, its place among those of its class, its text.
ITEM = "struct<class:int,owner:string,ord:string,value:string>"


def item(name: str, owner: Column, order: Column, value: Column) -> Column:
    return F.struct(F.lit(CLASSES.index(name)).alias("class"), owner.alias("owner"), order.alias("ord"), value.alias("value")).cast(ITEM)


def token_annotations(tokens: DataFrame, sentences: DataFrame, spans: DataFrame, morpho: DataFrame, edges: DataFrame, edge_foundry: str) -> DataFrame:
    """(text_id, tok_idx, items): all annotations, the form in which streams are merged. A token has a row for each source of
    annotations, not for each annotation, so few and compact rows meet in ``streams``.

    tokens: (text_id, tok_idx, from, to, surface); spans: (text_id, layer, from, to, depth, token_from, token_to), and
    attributes where there are any; morpho: with norm, orig, phon and trans where there are any."""
    at, none = ["text_id", "tok_idx"], F.lit("")
    s = lambda c: F.col(c).cast("string")
    spans = spans if "attributes" in spans.columns else spans.withColumn("attributes", F.lit(None).cast("map<string,string>"))
    foundry = F.substring_index("layer", "/", 1)

    def count(df: DataFrame, name: Column, order: Column, owner: Column = none) -> DataFrame:
        n = df.groupBy("text_id", name.alias("__name"), order.alias("__ord"), owner.alias("__owner")).agg(F.count(F.lit(1)).alias("n"))
        return n.select("text_id", F.lit(0).alias("tok_idx"), F.array(item("counts", F.col("__owner"), F.col("__ord"), F.concat(F.lit("-:"), F.col("__name"), F.lit("$<i>"), s("n")))).alias("items"))

    own = F.array(
        item("offsets", none, none, F.concat(F.lit("_"), s("tok_idx"), F.lit("$<i>"), s("from"), F.lit("<i>"), s("to"))), F.when(F.col("surface") != "", item("lower", none, none, F.concat(F.lit("i:"), escape_value(F.lower("surface"))))),
        F.when(~is_word(F.col("surface")), item("nonword", F.lit("base"), none, F.lit("base/p:_"))), item("surface", none, none, F.concat(F.lit("s:"), escape_value(F.col("surface")))),
    )
    attributed = F.size(F.coalesce("attributes", F.create_map())) > 0
    span = F.concat(F.lit("<>:"), F.col("layer"), F.lit("$<b>64<i>"), s("from"), F.lit("<i>"), s("to"), F.lit("<i>"), s("token_to"), F.lit("<b>"), s("depth"), F.when(attributed, F.concat(F.lit("<s>"), s("depth"))).otherwise(""))
    order = _span_order(F.col("depth"), F.col("layer"), F.col("from"))
    attribute = lambda a, i: item("spans", foundry, F.concat(order, F.lit(":a"), F.lpad(i.cast("string"), 6, "0")), attribute_annotation(a["key"], a["value"], F.col("depth"), F.col("token_to")))
    placed = F.concat(F.array(item("spans", foundry, order, span)), F.when(attributed, F.transform(F.map_entries("attributes"), attribute)).otherwise(F.array().cast(f"array<{ITEM}>")))

    pre = foundry_prefix(F.col("foundry"))
    m = morpho.join(tokens.select("text_id", "tok_idx", "from", "to"), ["text_id", "from", "to"]).filter(pre.isNotNull())
    some = lambda c, a: F.when(_given(c), a).otherwise(F.array().cast("array<string>"))
    plain = lambda k, c: F.transform(c, lambda x: F.concat(pre, F.lit(f"/{k}:"), escape_value(x)))
    misc = F.coalesce("misc", F.lit("_"))
    lemma = F.split(rank.sorted_lemma(F.col("lemma"), F.col("xpos"), misc), r"\|")
    values = F.concat(
        some("feats", rank.features(pre, F.col("feats"))), some("xpos", rank.payloads(pre, F.col("xpos"), misc)), some("lemma", plain("l", lemma)),
        some("upos", F.when(F.col("foundry") != "tree_tagger", plain("u", F.array("upos"))).otherwise(F.array().cast("array<string>"))), *[some(c, plain(c, F.split(c, r"\|"))) for c in EXTRA if c in morpho.columns],
    )
    read = F.transform(values, lambda v, i: item("foundry", pre, F.lpad(i.cast("string"), 6, "0"), v))

    f = F.lit(edge_foundry)
    rel, goal = F.concat(f, F.lit("/d:"), escape_value(F.col("deprel"))), F.concat(F.lit("$<b>32<i>"), s("other"))
    out = item("foundry", f, F.lit("z"), F.concat(F.lit(">:"), rel, goal))
    back = item("inverse", f, F.concat_ws(":", F.concat(f, F.lit("/"), F.col("deprel")), F.lpad(s("other"), 10, "0")), F.concat(F.lit("<:"), rel, goal))
    root = item("foundry", f, F.lit("z"), F.concat(F.lit("<:"), rel, F.lit("$<b>34<i>"), s("from"), F.lit("<i>"), s("to"), F.lit("<i>"), s("tok_idx"), F.lit("<i>1")))
    rooted = edges.filter("kind = 'root'").join(tokens.select("text_id", "tok_idx", "from", "to"), at)
    parts = [
        count(spans.filter(F.col("layer").endswith(":p") & (foundry != "base")), F.lit("base/paragraphs"), F.lit("0")), count(sentences, F.lit("base/sentences"), F.lit("1")),
        count(spans.filter(F.col("layer").endswith("/s:s") & ~foundry.isin(*STRUCTURE)), F.concat(foundry, F.lit("/sentences")), F.concat(F.lit("1:"), foundry), foundry), count(tokens, F.lit("tokens"), F.lit("2")),
        tokens.select(*at, F.filter(own, lambda x: x.isNotNull()).alias("items")), spans.select("text_id", F.col("token_from").alias("tok_idx"), placed.alias("items")), m.select(*at, read.alias("items")),
        edges.filter("kind <> 'root'").select(*at, F.array(F.when(F.col("kind") == "out", out).otherwise(back)).alias("items")), rooted.select(*at, F.array(root).alias("items")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def parse_streams(rows: DataFrame) -> DataFrame:
    """Annotations, as ``token_annotations`` gives them, of (text_id, tok_idx, stream): class, owner and place of each follow from
    its text alone; an attribute belongs to the span before it."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    is_span = lambda v: v.startswith("<>:")
    span = r"^<>:((?:[^$\\]|\\.)*)\$<b>64<i>([0-9]+)<i>[0-9]+<i>[0-9]+<b>([0-9]+)"
    span_order = lambda v: _span_order(F.regexp_extract(v, span, 3).try_cast("int"), F.regexp_extract(v, span, 1), F.regexp_extract(v, span, 2))
    # only evaluated for attributes, which are few
    holder = lambda i: F.element_at(F.filter(F.slice("stream", 1, i + 1), is_span), -1)

    def read(v, i):
        get = lambda p, g=1: F.regexp_extract(v, p, g)
        counted, of_foundry = get(r"^-:([^/$]+)/"), get(r"^(?:[<>]:)?([^/:]+)/")
        count_order = F.when(v.startswith("-:base/paragraphs"), "0").when(v.startswith("-:base/sentences"), "1").when(v.startswith("-:tokens"), "2").otherwise(F.concat(F.lit("1:"), counted))
        label = F.replace(get(r"^<:((?:[^$\\]|\\.)*)\$<b>32"), F.lit("/d:"), F.lit("/"))
        none = F.lit("")
        return (
            F.when(v.startswith("s:"), item("surface", none, none, v)).when(v.startswith("i:"), item("lower", none, none, v)).when(v == "base/p:_", item("nonword", F.lit("base"), none, v)).when(v.rlike(r"^_[0-9]+\$"), item("offsets", none, none, v))
            .when(v.startswith("-:"), item("counts", F.when(counted.isin("", *STRUCTURE), "").otherwise(counted), count_order, v)).when(is_span(v), item("spans", get(r"^<>:([^/]+)/"), span_order(v), v))
            .when(v.startswith("@:"), item("spans", F.regexp_extract(holder(i), r"^<>:([^/]+)/", 1), F.concat(span_order(holder(i)), F.lit(":a"), pad(i, 6)), v))
            .when(v.startswith("<:") & v.contains("$<b>32"), item("inverse", of_foundry, F.concat_ws(":", label, pad(get(r"<i>([0-9]+)$"), 10)), v))
            .otherwise(item("foundry", of_foundry, F.when(v.startswith(">:") | v.startswith("<:"), "z").otherwise(pad(i, 6)), v))
        )

    return rows.select("text_id", "tok_idx", F.transform("stream", read).alias("items"))


def stream_tokens(rows: DataFrame) -> DataFrame:
    """(text_id, tok_idx, from, to) of annotations: what an update joins its spans to, without the base layers."""
    at = rows.select("text_id", "tok_idx", F.get(F.filter("items", lambda x: x["class"] == CLASSES.index("offsets")), F.lit(0))["value"].alias("v")).filter("v IS NOT NULL")
    get = lambda g: F.regexp_extract("v", r"^_[0-9]+\$<i>([0-9]+)<i>([0-9]+)", g).cast("int")
    return at.select("text_id", "tok_idx", get(1).alias("from"), get(2).alias("to"))


def owners_of(rows: DataFrame) -> DataFrame:
    """(text_id, owner) of annotations."""
    return rows.select("text_id", F.explode(F.array_distinct(F.transform("items", lambda x: x["owner"]))).alias("owner")).distinct()


def patch_foundries(rows: DataFrame, new: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Annotations after an update: a supplied foundry replaces all of its own; others stay. owners: (text_id, owner) of
    foundries that are supplied, also where they have no annotation left; by default those of ``new``."""
    owners = owners_of(new) if owners is None else owners
    gone = owners.groupBy("text_id").agg(F.collect_set("owner").alias("__gone"))
    kept = F.filter("items", lambda x: F.col("__gone").isNull() | ~F.array_contains("__gone", x["owner"]))
    return rows.join(gone, "text_id", "left").select("text_id", "tok_idx", kept.alias("items")).unionByName(new.select("text_id", "tok_idx", "items"))


def patch_layers(old: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """(text_id, rank, layer) after an update of ``owners``."""
    mine = old.withColumn("owner", F.substring_index("layer", "/", 1)).join(owners.select("text_id", "owner").distinct(), ["text_id", "owner"], "left_anti").drop("owner")
    return mine.unionByName(new).distinct()


def streams(rows: DataFrame) -> DataFrame:
    """(text_id, tok_idx, stream): a token's annotations in canonical order."""
    order = lambda x: F.struct(x["class"].alias("c"), F.when(x["class"] == CLASSES.index("foundry"), x["owner"]).otherwise("").alias("o"), x["ord"].alias("r"), x["value"].alias("v"))
    items = F.sort_array(F.transform(F.flatten(F.collect_list("items")), order))
    return rows.groupBy("text_id", "tok_idx").agg(F.transform(items, lambda x: x["v"]).alias("stream"))


def attribute_annotation(key: Column, value: Column, depth: Column, token_to: Column, prefix: str = "dereko/s") -> Column:
    """The annotation of a span's attribute."""
    body = F.when(F.length(value) == 0, key).otherwise(F.concat(key, F.lit(":"), escape_attribute(value)))
    return F.concat(F.lit(f"@:{prefix}:"), body, F.lit("$<b>17<s>"), depth.cast("string"), F.lit("<i>"), token_to.cast("string"))


def field_list(values: dict[str, tuple[str, Column]]) -> Column:
    """A text's fields as a list of (pos, key, type, value), see ``fields``."""
    part = F.split(sigle(F.col("text_id")), "/")
    fixed = {"corpusSigle": ("type:string", part[0]), "docSigle": ("type:string", F.concat_ws("/", part[0], part[1])), "textSigle": ("type:string", sigle(F.col("text_id")))}
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.lit(t).alias("type"), v.cast("string").alias("value")) for i, (k, (t, v)) in enumerate({**fixed, **values}.items())])
    return F.filter(entries, lambda x: x["value"].isNotNull() & (F.trim(x["value"]) != ""))


def fields(texts: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """(text_id, pos, key, type, value): sigles first, then given fields in order; blanks are left out."""
    return texts.select("text_id", F.explode(field_list(values)).alias("f")).select("text_id", "f.*")


#: Header fields in the order of a document, each with its type. ``link``: an address with a title, ``data``: a value in a data
#: address. Fixed values.
HEADER_FIELDS = {
    "corpusEditor": "data", "distributor": "data", "editor": "data", "translator": "data", "externalLink": "link", "publisher": "data", "reference": "data",
    "creationDate": "type:date", "pubDate": "type:date", "textClass": "type:keywords", "award": "type:keywords", "availability": "type:string", "language": "type:string",
    "ISBN": "type:string", "URN": "urn", "pubPlace": "type:string", "pubPlaceKey": "type:string", "textType": "type:string", "textTypeArt": "type:string",
    "textTypeRef": "type:string", "textDomain": "type:string", "textColumn": "type:string", "author": "type:text", "title": "type:text", "subTitle": "type:text",
    "corpusAuthor": "type:text", "corpusTitle": "type:text", "corpusSubTitle": "type:text", "docTitle": "type:text", "docAuthor": "type:text", "textExternalLink": "link",
    "tokenSource": "type:string",
}
ATTACHMENT = "type:attachement"


def header_fields(rows: DataFrame, plain: dict[str, str] | None = None, link_kind: str = "application/x.link", legacy: bool = False) -> DataFrame:
    """(text_id, pos, key, type, value, values): sigles, then the header fields that ``rows`` (see ``sources.headers.fields``)
    have, in order; keywords are in ``values``. plain: type of fields, such as translator and publisher, that are to
    be no data addresses; legacy: older names where a field was renamed. A link's title is its own, else the publisher."""
    kinds = {**HEADER_FIELDS, **(plain or {})}
    some = lambda c: F.when(F.trim(c) != "", c)
    part = F.split(sigle(F.col("text_id")), "/")
    three = lambda c: F.when(F.size(part) >= 3, c)
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    found = [("corpusSigle", "type:string", three(part[0]), no_list), ("docSigle", "type:string", three(F.concat_ws("/", F.get(part, F.lit(0)), F.get(part, F.lit(1)))), no_list), ("textSigle", "type:string", three(sigle(F.col("text_id"))), no_list)]
    publisher = some(F.col("publisher")) if "publisher" in rows.columns else none
    for key, kind in kinds.items():
        if key not in rows.columns:
            continue
        c = F.col(key)
        if kind == "type:keywords":
            found.append((key, kind, none, F.when(F.size(c) > 0, c)))
        elif kind == "urn":
            found.append((key, ATTACHMENT, F.concat(F.lit(f"data:{link_kind};title="), encode_form(c["urn"]), F.lit(","), encode_form(c["url"])), no_list))
        elif kind == "link":
            title = some(F.col(f"{key}Title")) if f"{key}Title" in rows.columns else none
            found.append((key, ATTACHMENT, link_uri(link_kind, F.coalesce(title, publisher, F.lit("Link")), some(c)), no_list))
        else:
            found.append((key, ATTACHMENT if kind == "data" else kind, data_uri(some(c)) if kind == "data" else some(c), no_list))
    name = lambda k: legacy_name(F.lit(k)) if legacy else F.lit(k)
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), name(k).alias("key"), F.lit(t).alias("type"), v.cast("string").alias("value"), vs.alias("values")) for i, (k, t, v, vs) in enumerate(found)])
    return rows.select("text_id", F.explode(F.filter(entries, lambda x: x["value"].isNotNull() | x["values"].isNotNull())).alias("f")).select("text_id", "f.*")


def more_fields(header: DataFrame, extra: DataFrame) -> DataFrame:
    """``header`` fields and, behind them, those of ``extra`` (text_id, pos, key, type, value_str, value_list) whose key is new."""
    new = extra.join(header.select("text_id", "key").distinct(), ["text_id", "key"], "left_anti")
    rows = header.withColumn("__new", F.lit(0)).unionByName(new.select("text_id", "pos", "key", "type", F.col("value_str").alias("value"), F.col("value_list").alias("values"), F.lit(1).alias("__new")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("text_id").orderBy("__new", "pos", "key")) - 1).drop("__new")


def patch_fields(old: DataFrame, new: DataFrame, aliases: dict[str, str] | None = None, replace: bool = True) -> DataFrame:
    """Fields after an update. replace: a new value takes the old one's place, else is appended; later duplicates and
    aliases of a patched key go. Otherwise only missing keys are appended. A column ``mode`` (replace or append) of ``new``
    says so field by field."""
    canonical = F.col("key")
    for a, b in (LEGACY_ALIASES | (aliases or {})).items():
        canonical = F.when(F.col("key") == a, b).otherwise(canonical)
    n = new if "mode" in new.columns else new.withColumn("mode", F.lit("replace" if replace else "append"))
    o, n = old.withColumn("__k", canonical), n.withColumn("__k", canonical)
    first = o.groupBy("text_id", "__k").agg(F.min("pos").alias("__pos"))
    placed = n.join(first, ["text_id", "__k"], "left").filter("mode = 'replace' OR __pos IS NULL")
    # (place among the old fields, or behind them all; order among the new)
    add = placed.withColumn("__at", F.struct(F.col("__pos").isNull().alias("new"), F.coalesce("__pos", F.col("pos")).alias("pos"))).drop("__pos", "mode")
    replaced = n.filter("mode = 'replace'").select("text_id", "__k").distinct()
    kept = o.join(replaced, ["text_id", "__k"], "left_anti").withColumn("__at", F.struct(F.lit(False).alias("new"), F.col("pos").alias("pos")))
    rows = kept.unionByName(add.select(*kept.columns))
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("text_id").orderBy("__at", "key")) - 1).cast("int")).drop("__k", "__at")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), escape_json(c), F.lit('"'))


def fields_json(fields: Column) -> Column:
    """The JSON of a ``field_list``, without brackets; null if it is empty."""
    one = lambda f: F.concat(F.lit('{"@type":"field","type":'), _quoted(f["type"]), F.lit(',"key":'), _quoted(f["key"]), F.lit(',"value":'), _quoted(f["value"]), F.lit("}"))
    return F.when(F.size(fields) > 0, F.array_join(F.transform(fields, one), ","))


def field_json(values: bool) -> Column:
    """A field as JSON, of the columns key, type, value and, with ``values``, values."""
    listed = lambda: F.concat(F.lit("["), F.array_join(F.transform("values", _quoted), ","), F.lit("]"))
    value = F.coalesce(_quoted(F.col("value")), listed()) if values else _quoted(F.col("value"))
    return F.concat(F.lit('{"@type":"field","type":'), _quoted(F.col("type")), F.lit(',"key":'), _quoted(F.col("key")), F.lit(',"value":'), value, F.lit("}"))


def _gathered(key: str, v: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), v.alias("v")))), lambda x: x["v"]), ",")


def stream_json(stream_rows: DataFrame) -> DataFrame:
    """(text_id, stream): the JSON of a text's stream without its brackets."""
    token = F.concat(F.lit("["), F.array_join(F.transform("stream", _quoted), ","), F.lit("]"))
    return stream_rows.groupBy("text_id").agg(_gathered("tok_idx", token).alias("stream"))


def documents(texts: DataFrame, field_rows: DataFrame, summary: DataFrame, stream_rows: DataFrame, envelope: dict[str, str] | None = None) -> DataFrame:
    """(text_id, json): the index document of each text; of texts without tokens there is none. envelope: members that stand
    before the fields."""
    q = _quoted
    fs = field_rows.groupBy("text_id").agg(_gathered("pos", field_json("values" in field_rows.columns)).alias("fs"))
    rows = texts.select("text_id", "text").join(fs, "text_id").join(summary, "text_id").join(stream_json(stream_rows), "text_id")
    before = "".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in (envelope or {}).items())
    parts = [F.lit("{" + before + '"fields":['), F.col("fs"), F.lit('],"data":{"text":'), q(F.col("text")), F.lit(',"layerInfos":'), q(F.col("layer_infos")), F.lit(',"foundries":'), q(F.col("foundries")), F.lit(',"name":"tokens","stream":['), F.col("stream"), F.lit("]}}")]
    return rows.select("text_id", F.concat(*parts).alias("json"))
