"""Header fields: each header is parsed once, for about thirty fields and the typed extra fields of its xeno block."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.meta import note_id
from .layers import without_comments

#: Field -> places in falling precedence; ``a/b`` is the first b within the first a, ``@k=v`` asks for an attribute. Fixed values.
PLACES = {
    "sigle": ["textSigle", "dokumentSigle", "korpusSigle"],
    "author": ["analytic/h.author", "monogr/h.author", "h.author", "author@role=primary", "author"],
    "title": ["analytic/h.title@type=main", "analytic/h.title", "monogr/h.title@type=main", "monogr/h.title", "d.title", "c.title@type=main", "c.title", "title@type=main", "title"],
    "subTitle": ["analytic/h.title@type=sub", "monogr/h.title@type=sub", "c.title@type=sub", "title@type=sub"],
    "translator": ["editor@role=translator"],
    "editor": ["analytic/editor", "monogr/editor", "editor"],
    "publisher": ["publisher"],
    "distributor": ["distributor"],
    "availability": ["availability"],
    "ISBN": ["idno@type=ISBN"],
    "URN": ["idno@type=URN"],
    "reference": ["reference@type=complete"],
    "textType": ["textDesc/textType"],
    "textDomain": ["textDesc/textDomain"],
    "textTypeArt": ["textDesc/textTypeArt"],
    "textTypeRef": ["textDesc/textTypeRef"],
    "textColumn": ["textDesc/column"],
    "pubPlace": ["pubPlace"],
    "created": ["creatDate"],
    "dated": ["date"],
    "textExternalLink": ["analytic/biblNote@n=url", "monogr/biblNote@n=url"],
}
#: Field -> (place, attribute), in falling precedence; fixed values.
ATTRIBUTES = {
    "pubPlaceKey": [("pubPlace", "key")],
    "when": [("date", "when")],
    "externalLink": [("ref@type=page_url", "target"), ("link@target", "target")],
    "textExternalLinkTitle": [("analytic/biblNote@n=url", "rend"), ("monogr/biblNote@n=url", "rend")],
}
XENO = "array<struct<project:string,name:string,type:string,desc:string,value:string>>"
_XENO = pa.list_(pa.struct([(k, pa.string()) for k in ("project", "name", "type", "desc", "value")]))
_LISTS = {"award": "array<string>", "topics": "array<string>", "notes": "array<string>", "xeno": XENO}


def _at(node, place: str):
    for step in place.split("/"):
        tag, _, want = step.partition("@")
        key, _, value = want.partition("=")
        node = next((e for e in node.iter(tag) if not key or (e.get(key) == value if value else e.get(key) is not None)), None)
        if node is None:
            return None
    return node


def _topics(node) -> list[str]:
    return [] if node is None else [t for e in node.iter("catRef") for t in e.get("target", "").split(".")[1:] if t.strip()]


def read_header(xml: str | None) -> dict:
    """Raw fields of one header; a missing or malformed one has none."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return {}
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]  # without the name space
    words = lambda e: "" if e is None else "".join(e.itertext()).strip()
    out = {f: next((t for p in places if (t := words(_at(root, p)))), None) for f, places in PLACES.items()}
    out |= {f: next((t for p, a in places if (e := _at(root, p)) is not None and (t := e.get(a, "").strip())), None) for f, places in ATTRIBUTES.items()}
    typed = {e.get("type", "").strip(): words(e) for e in root.iter("pubDate") if words(e)}  # of the same type the last
    out |= {k: typed.get(k) for k in ("year", "month", "day")}
    out["plain"] = next((words(e) for e in root.iter("pubDate") if not e.get("type", "").strip() and words(e)), None)
    out["award"] = [s for e in root.iter("note") if e.get("type") == "award" and (s := e.get("subtype", "").strip())]
    out["topics"] = _topics(_at(root, "textClass")) or _topics(root)
    out["notes"] = [words(e) for e in root.iter("biblNote")]
    xeno = _at(root, "xenoData")
    out["xeno"] = [] if xeno is None else [{k: e.get(k, "").strip() for k in ("project", "name", "type", "desc")} | {"value": "".join(e.itertext())} for e in xeno.iter("meta")]
    return out


def header_level(rows: DataFrame) -> DataFrame:
    """``fields`` of headers by archive path (``path``), with (level, sigle): by the sigle that the header states, else by how
    deep it lies: one folder for a corpus, two for a document, more for a text."""
    part = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    depth = F.size(part)
    by_path = F.when(depth == 1, part[0]).when(depth >= 2, F.concat_ws("/", F.slice(part, 1, F.least(depth, F.lit(3)))))
    sigle = F.coalesce("sigle", by_path)
    level = F.when(F.size(F.split(sigle, "/")) >= 3, "text").when(F.size(F.split(sigle, "/")) == 2, "doc").otherwise("corpus")
    return rows.withColumns({"level": level, "sigle": sigle})


def fields(rows: DataFrame, language: str = "de", resolver: str = "http://nbn-resolving.de/") -> DataFrame:
    """A row of fields per header of (text_id, xml), with all other columns of ``rows``.

    A field that is nowhere is null, lists are empty; a null, empty or malformed header gives such a row. A translator
    displaces the editor. ``note`` is the id in the first bibliographic note that has one, from which links are derived;
    ``xeno`` holds the raw extra fields (see ``meta.xeno_fields``). ``resolver`` is the address before a URN."""
    plain = [*PLACES, *ATTRIBUTES, "year", "month", "day", "plain"]
    clash = [c for c in rows.columns if c in {*plain, *_LISTS, "creationDate", "pubDate", "textClass", "language", "note"}]
    ids = [c for c in rows.columns if c != "xml" and c not in clash]
    narrow = rows.select(*ids, without_comments(F.col("xml")).alias("xml"))

    def run(batches):
        for b in batches:
            found = [read_header(x) for x in b.column(len(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(ids))] + [pa.array([r.get(f) for r in found], pa.string()) for f in plain] + [pa.array([r.get(f) or [] for r in found], _XENO if f == "xeno" else pa.list_(pa.string())) for f in _LISTS],
                [*ids, *plain, *_LISTS],
            )

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "xml"] + [f"`{f}` string" for f in plain] + [f"`{k}` {v}" for k, v in _LISTS.items()]
    raw = narrow.mapInArrow(run, ", ".join(types))
    created = F.coalesce(tx.normalise_date(F.col("created")), F.translate("created", ".", "-"))
    stamp = F.coalesce("when", "dated")
    published = F.coalesce(tx.compose_date(F.col("year"), F.col("month"), F.col("day"), F.col("plain")), tx.normalise_date(stamp), stamp)
    out = raw.withColumns({"creationDate": F.coalesce(created, published), "pubDate": F.coalesce(published, created)})
    return out.withColumns({
        "editor": F.when(F.col("translator").isNull(), F.col("editor")),
        "textType": F.coalesce("textType", F.concat("textTypeArt", F.lit("en"))),
        "language": F.lit(language),
        "URN": F.when(F.col("URN").isNotNull(), F.struct(F.col("URN").alias("urn"), F.concat(F.lit(resolver), F.col("URN")).alias("url"))),
        "note": F.get(F.filter(F.transform("notes", note_id), lambda x: x.isNotNull()), F.lit(0)),
    }).withColumnRenamed("topics", "textClass").drop("created", "year", "month", "day", "plain", "dated", "when", "notes")
