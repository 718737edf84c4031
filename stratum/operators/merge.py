"""Update of index documents: what an update doesn't touch stays as it is, byte for byte.

Documents are read into field and annotation rows only where an update concerns them. The parts that change are
computed as rows, in the same operators that make documents, and put in the place of the old parts in the text.
"""

from __future__ import annotations

import json
from json.decoder import JSONDecoder, scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import index

_DOCUMENT = "fields array<struct<key:string,type:string,value:string>>, data struct<text:string,layerInfos:string,foundries:string,stream:array<array<string>>>"


def text_id_of(textsigle: Column, name: Column | None = None) -> Column:
    """C_D.T of the sigle C/D/T; without one, of an entry's file name, which has the same separator everywhere."""
    part = F.split(textsigle, "/", 3)
    of_sigle = F.when(F.size(part) == 3, F.concat(part[0], F.lit("_"), part[1], F.lit("."), part[2])).otherwise(F.translate(textsigle, "/", "_"))
    if name is None:
        return of_sigle
    bare = F.split(F.regexp_replace(name, r"\.json(?:\..*)?$", ""), "-", 3)
    of_name = F.when(F.size(bare) == 3, F.concat(bare[0], F.lit("_"), bare[1], F.lit("."), bare[2]))
    return F.coalesce(of_sigle, of_name)


def text_id(textsigle: str | None) -> str | None:
    """As ``text_id_of``, of a string."""
    if textsigle is None:
        return None
    part = textsigle.split("/", 2)
    return f"{part[0]}_{part[1]}.{part[2]}" if len(part) == 3 else textsigle.replace("/", "_")


def read_documents(docs: DataFrame) -> DataFrame:
    """(text_id, fields, data, json) and the other columns of ``docs`` (json, and name where there is one)."""
    rows = docs.withColumn("__d", F.from_json("json", _DOCUMENT))
    of_sigle = F.get(F.filter("__d.fields", lambda x: x["key"] == "textSigle"), F.lit(0))["value"]
    name = F.col("name") if "name" in docs.columns else None
    return rows.select(text_id_of(of_sigle, name).alias("text_id"), F.col("__d.fields").alias("fields"), F.col("__d.data").alias("data"), *[c for c in docs.columns if c != "text_id"])


def field_rows(read: DataFrame) -> DataFrame:
    """(text_id, pos, key, type, value, values) of ``read_documents``."""
    rows = read.select("text_id", F.posexplode("fields").alias("pos", "f")).select("text_id", "pos", "f.*")
    listed = F.when(F.col("type") == "type:keywords", F.from_json("value", "array<string>"))
    return rows.select("text_id", "pos", "key", "type", F.when(listed.isNull(), F.col("value")).alias("value"), listed.alias("values"))


def annotation_rows(read: DataFrame) -> DataFrame:
    """(text_id, tok_idx, items) of ``read_documents``, see ``index.token_annotations``."""
    return index.parse_streams(read.select("text_id", F.posexplode("data.stream").alias("tok_idx", "stream")))


def member_ranges(text: str, at: int = 0) -> dict[str, tuple[int, int]]:
    """(first, behind the last character) of each member's value of the JSON object that starts at ``at``."""
    skip, out = JSONDecoder().raw_decode, {}
    at = _space(text, at) + 1
    while text[at := _space(text, at)] != "}":
        if text[at] == ",":
            at = _space(text, at + 1)
        key, at = scanstring(text, at + 1, True)
        start = _space(text, _space(text, at) + 1)
        _, at = skip(text, start)
        out[key] = (start, at)
    return out


def element_ranges(text: str, at: int) -> list[tuple[int, int]]:
    """(first, behind the last character) of each element of the JSON array that starts at ``at``."""
    skip, out = JSONDecoder().raw_decode, []
    at += 1
    while text[at := _space(text, at)] != "]":
        if text[at] == ",":
            at = _space(text, at + 1)
        _, end = skip(text, at)
        out.append((at, end))
        at = end
    return out


def _space(text: str, at: int) -> int:
    while text[at] in " \t\r\n":
        at += 1
    return at


def splice(text: str, fields: list[tuple[str, str, str]], parts: dict[str, str]) -> str:
    """A document with its fields updated by (key, JSON, mode) and the members ``parts`` of its data replaced; all else,
    white space and unknown members too, stays as it is."""
    top, changes = member_ranges(text), []
    if fields:
        changes += _field_changes(text, *top["fields"], fields)
    if parts:
        data = member_ranges(text, top["data"][0])
        changes += [(*data[k], v) for k, v in parts.items() if k in data]
    out, at = [], 0
    for start, end, new in sorted(changes):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def _field_changes(text: str, start: int, end: int, fields: list[tuple[str, str, str]]):
    aliases = index.LEGACY_ALIASES
    places = element_ranges(text, start)
    keys = [aliases.get(k, k) for k in ((json.loads(text[a:b]) or {}).get("key") for a, b in places)]
    put, gone, more = {}, set(), []
    for key, new, mode in fields:
        found = [i for i, k in enumerate(keys) if k == aliases.get(key, key)]
        if not found:
            more.append(new)
        elif mode == "replace":
            put[found[0]] = new
            gone |= set(found[1:])
    if put or gone or more:
        yield start + 1, end - 1, ",".join([put.get(i, text[a:b]) for i, (a, b) in enumerate(places) if i not in gone] + more)


def merge(docs: DataFrame, fields: DataFrame | None = None, annotations: DataFrame | None = None, layers: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """``docs`` (name, json) after an update.

    fields: (text_id, pos, key, type, value, values, mode), see ``meta.guard_dates``; annotations: those of
    supplied foundries; layers: (text_id, rank, layer) of theirs; owners: (text_id, owner) supplied, by default those of
    ``annotations``. Updates of texts that aren't among ``docs`` do nothing (see ``unmatched``)."""
    ids = None
    for rows in (fields, annotations, owners):
        if rows is not None:
            ids = rows.select("text_id") if ids is None else ids.unionByName(rows.select("text_id"))
    if ids is None:
        return docs
    read = read_documents(docs)
    concerned = read.join(ids.distinct(), "text_id", "left_semi")
    update = concerned.select("text_id")
    if fields is not None:
        values = fields if "values" in fields.columns else fields.withColumn("values", F.lit(None).cast("array<string>"))
        one = F.struct("pos", "key", index.field_json(True).alias("json"), "mode")
        update = update.join(values.groupBy("text_id").agg(F.sort_array(F.collect_list(one)).alias("new_fields")), "text_id", "left")
    else:
        update = update.withColumn("new_fields", F.lit(None).cast("array<struct<pos:int,key:string,json:string,mode:string>>"))
    if annotations is not None:
        owners = index.owners_of(annotations) if owners is None else owners
        texts = concerned.join(owners.select("text_id").distinct(), "text_id", "left_semi")
        stream = index.stream_json(index.streams(index.patch_foundries(annotation_rows(texts), annotations.join(texts.select("text_id"), "text_id", "left_semi"), owners)))
        old = index.parse_layers(texts.select("text_id", F.col("data.layerInfos").alias("layer_infos")))
        summary = index.layer_summary(index.patch_layers(old, layers.join(texts.select("text_id"), "text_id", "left_semi"), owners))
        update = update.join(stream, "text_id", "left").join(summary, "text_id", "left")
    else:
        update = update.withColumns({c: F.lit(None).cast("string") for c in ("stream", "layer_infos", "foundries")})
    rows = read.drop("fields", "data").join(update, "text_id", "left")

    def run(batches):
        for b in batches:
            out = []
            for old, new_fields, stream, infos, foundries in zip(*(b.column(c).to_pylist() for c in ("json", "new_fields", "stream", "layer_infos", "foundries"))):
                parts = {} if stream is None else {"stream": f"[{stream}]", "layerInfos": json.dumps(infos, ensure_ascii=False), "foundries": json.dumps(foundries, ensure_ascii=False)}
                changed = [(f["key"], f["json"], f["mode"]) for f in new_fields or ()]
                out.append(splice(old, changed, parts) if changed or parts else old)
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.string())], ["name", "json"])

    return rows.mapInArrow(run, "name string, json string")


def unmatched(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text_id) of updates whose text is not among ``docs``: they are left out of a merge, and reported."""
    return ids.select("text_id").distinct().join(read_documents(docs).select("text_id"), "text_id", "left_anti")


def checked(tars: list[str], target: str, updates: int) -> None:
    """What a merge refuses: several archives, none, an update of nothing, and writing over the archive that it reads."""
    if len(tars) != 1:
        raise ValueError(f"a merge takes one archive of documents, not {len(tars)}")
    if not updates:
        raise ValueError("nothing to merge: give headers, stand-off files or annotation archives")
    if tars[0] == target:
        raise ValueError(f"{target} is read and would be written over")

