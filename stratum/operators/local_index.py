"""Index documents of whole texts: their streams, JSON, reading back and update, over the flat layers of ``local``.

The annotations, their order and the summaries are those of ``index`` and ``merge``. A token's annotations are put in place by
counting, since most sources have one for each token in order; only where a source isn't in order are its places sorted.
"""

from __future__ import annotations

import functools
import hashlib
import io
import re
from dataclasses import dataclass
from json.decoder import JSONDecoder, scanstring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json

from ..functions.text import PREFIXES
from . import index, local
from .local import Layer, Relations, Spans, Tokens, glue, strings
from .merge import _space

COUNTS, SPANS, OFFSETS, LOWER, NONWORD, INVERSE, FOUNDRY, SURFACE = range(len(index.CLASSES))


@dataclass
class Source:
    """Annotations of one class and owner: the token and the number of each among ``values``. order: place among those of the class;
    None where tokens stand in order and so do those of a token, whose places are then numbers of six digits."""

    kind: int
    owner: str
    token: np.ndarray
    values: pa.Array
    code: np.ndarray
    order: pa.Array | None = None


def prefix(foundry: str) -> str | None:
    return None if foundry == "base" else PREFIXES.get(foundry, foundry)


def _escape(v: str) -> str:
    return v.replace("#", "\\#").replace("$", "\\$")


def escape_values(a: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(a, "#", "\\#"), "$", "\\$")


def _lines(kind: int, owner: str, token: np.ndarray, values: pa.Array, order: pa.Array | None = None) -> Source:
    return Source(kind, owner, token, values, np.arange(len(token)), order)


def token_range(t: Tokens, s: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spans of texts with tokens, token_from, token_to) as ``align.token_range``."""
    kept = np.flatnonzero(np.diff(t.first)[s.text] > 0)
    text, start, end = s.text[kept], s.start[kept], s.end[kept]
    size = int(max(t.end.max(initial=0), s.end.max(initial=0), s.start.max(initial=0))) + 2
    low, high = t.first[text], t.first[text + 1]
    a = np.searchsorted(t.text * size + t.start, text * size + start)
    b = np.searchsorted(t.text * size + t.end, text * size + end, side="right") - 1
    some = lambda ok, i, other: np.where(ok, i - low, other)
    first = some((a < high) & (t.start[np.minimum(a, len(t.start) - 1)] < end), a, 0)
    last = some((b >= low) & (t.end[np.maximum(b, 0)] > start), b + 1, high - low)
    return kept, first, last


def count(t: Tokens, name: str, order: str, of: np.ndarray, owner: str = "") -> Source:
    """How many rows each text has; of: the text of each row."""
    n = np.bincount(of, minlength=len(t.ids))
    texts = np.flatnonzero((n > 0) & (np.diff(t.first) > 0))
    return _lines(COUNTS, owner, t.first[texts], glue(f"-:{name}$<i>", strings(n[texts])), pa.repeat(order, len(texts)))


def spans(t: Tokens, s: Spans, layer: str, depth: int) -> Source:
    """Spans of one layer, each at its first token."""
    kept, first, last = token_range(t, s)
    text, start, end = s.text[kept], strings(s.start[kept]), strings(s.end[kept])
    value = glue(f"<>:{layer}$<b>64<i>", start, "<i>", end, "<i>", strings(last), f"<b>{depth}")
    order = glue(f"{999_999 - depth:06d}:{layer}:", pc.utf8_lpad(start, 10, "0"))
    return _lines(SPANS, layer.split("/")[0], t.first[text] + first, value, order)


def own(t: Tokens) -> list[Source]:
    """A token's offsets, its surface in either form, and whether it is no word."""
    n, code = np.arange(len(t.text)), t.code
    other = pc.invert(pc.match_substring_regex(t.words, r"[\pL\p{Nd}_\p{So}\x{10000}-\x{10FFFF}]")).to_numpy(zero_copy_only=False)
    nonword = np.flatnonzero(other[code]) if len(other) else n
    return [
        _lines(OFFSETS, "", n, glue("_", strings(t.idx), "$<i>", strings(t.start), "<i>", strings(t.end))), Source(LOWER, "", n, glue("i:", escape_values(pc.utf8_lower(t.words))), code),
        Source(NONWORD, "base", nonword, pa.array(["base/p:_"]), np.zeros(len(nonword), np.int64)), Source(SURFACE, "", n, glue("s:", escape_values(t.words)), code),
    ]


def _payloads(pre: str, xpos: str, misc: str) -> list[str]:
    v, numbers = xpos.split("|"), [local._number(x) for x in misc.split("|")]
    if len(v) == 1:
        return [f"{pre}/p:{_escape(xpos)}"]
    rows = [(None if i >= len(numbers) or numbers[i] is None else -numbers[i], i, x) for i, x in enumerate(v)]
    if len(numbers) == len(v) and None not in numbers:
        rows = local._by_certainty(v, numbers)
    return [f"{pre}/p:{_escape(x)}" + ("" if p is None else f"$<b>129<b>{round(-p * 255)}") for p, _, x in rows]


@functools.lru_cache(1 << 17)
def _values(foundry, lemma, upos, xpos, feats, misc, *extra) -> list[str]:
    """A reading's annotations in order, see ``index.token_annotations``."""
    pre, given, out = prefix(foundry), (lambda c: c is not None and c != "_"), []
    if given(feats):
        parts = [p for x in feats.split("|") if len(p := x.split("=")) == 2]
        out += sorted(f"{pre}/m:{_escape(k.lower())}:{_escape(v.lower())}" for k, v in parts)
    if given(xpos):
        out += _payloads(pre, xpos, misc or "_")
    if given(lemma):
        out += [f"{pre}/l:{_escape(x)}" for x in (local.sorted_lemma(lemma, xpos, misc or "_") if "|" in lemma else lemma).split("|")]
    if given(upos) and foundry != "tree_tagger":
        out.append(f"{pre}/u:{_escape(upos)}")
    for k, c in zip(index.EXTRA, extra):
        if given(c):
            out += [f"{pre}/{k}:{_escape(x)}" for x in c.split("|")]
    return out


def readings(t: Tokens, m: Layer) -> list[Source]:
    pre = prefix(m.foundry)
    at = local.find(m, t)
    if pre is None or not (at >= 0).any():
        return []
    lists = local.made(m, functools.partial(_values, m.foundry), "lemma", "upos", "xpos", "feats", "misc", *index.EXTRA)
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    token, code = at[at >= 0], m.code[at >= 0]
    n = size[code]
    values = pa.array([v for x in lists for v in x], pa.string())
    once = (token[1:] > token[:-1]).all()
    place = None if once else pc.utf8_lpad(strings(local.spread(np.zeros(len(n), np.int64), n)), 6, "0")
    return [Source(FOUNDRY, pre, np.repeat(token, n), values, local.spread((np.cumsum(size) - size)[code], n), place)]


def edges(t: Tokens, r: Relations) -> list[Source]:
    """Of relations: out of a token, into its head, and those of roots, as ``align.edges``."""
    rel, goal = local.heads(t, r)
    token = np.flatnonzero(rel >= 0)
    rel = rel[token]
    token, rel = token[pc.is_valid(r.labels).to_numpy(zero_copy_only=False)[r.code[rel]]], rel[pc.is_valid(r.labels).to_numpy(zero_copy_only=False)[r.code[rel]]]
    linked, f = goal[rel] >= 0, r.foundry
    a, b, root = token[linked], goal[rel][linked], token[~linked & (r.head_start[rel] == 0)]
    label = escape_values(r.labels)
    name = lambda x, ls: ls.take(pa.array(r.code[x]))
    of_root = rel[~linked & (r.head_start[rel] == 0)]
    z = lambda x: pa.repeat("z", len(x))
    other, head = strings(t.idx[a]), strings(t.idx[b])
    return [
        _lines(FOUNDRY, f, a, glue(f">:{f}/d:", name(rel[linked], label), "$<b>32<i>", head), z(a)),
        _lines(INVERSE, f, b, glue(f"<:{f}/d:", name(rel[linked], label), "$<b>32<i>", other), glue(f"{f}/", name(rel[linked], r.labels), ":", pc.utf8_lpad(other, 10, "0"))),
        _lines(FOUNDRY, f, root, glue(f"<:{f}/d:", name(of_root, label), "$<b>34<i>", strings(t.start[root]), "<i>", strings(t.end[root]), "<i>", strings(t.idx[root]), "<i>1"), z(root)),
    ]


def patch_foundries(sources: list[Source], new: list[Source], text: np.ndarray) -> list[Source]:
    """Annotations after an update: a supplied foundry replaces all of its own in the texts that have it anew; others stay. text: of
    each token."""
    out = []
    for s in sources:
        supplied = [x.token for x in new if x.owner == s.owner]
        if supplied:
            stays = np.flatnonzero(~np.isin(text[s.token], np.unique(text[np.concatenate(supplied)])))
            s = Source(s.kind, s.owner, s.token[stays], s.values, s.code[stays], None if s.order is None else s.order.take(pa.array(stays)))
        out.append(s)
    return out + new


@dataclass
class Streams:
    """Annotations of tokens in canonical order: those of token k are ``values`` of code[first[k]:first[k + 1]]."""

    first: np.ndarray
    code: np.ndarray
    values: pa.Array

    def joined(self, separator: str, values: pa.Array | None = None) -> pa.Array:
        return local.gathered((self.values if values is None else values).take(pa.array(self.code)), self.first, separator)


def _places(token: np.ndarray) -> pa.Array:
    at = local.runs(token)
    return pc.utf8_lpad(strings(np.arange(len(token)) - np.repeat(at[:-1], np.diff(at))), 6, "0")


def streams(n: int, sources: list[Source]) -> Streams:
    """The annotations of ``n`` tokens, by class, of foundries by owner, then by order and text."""
    groups: dict[tuple[int, str], list[Source]] = {}
    for s in sources:
        if len(s.token):
            groups.setdefault((s.kind, s.owner if s.kind == FOUNDRY else ""), []).append(s)
    pool: dict[int, tuple[int, pa.Array]] = {}  # values that several sources share count once
    at = 0
    for s in sources:
        if id(s.values) not in pool:
            pool[id(s.values)] = at, s.values
            at += len(s.values)
    parts, size = [], np.zeros(n, np.int64)
    for key in sorted(groups):
        group = groups[key]
        token, code = np.concatenate([s.token for s in group]), np.concatenate([s.code + pool[id(s.values)][0] for s in group])
        if len(group) > 1 or group[0].order is not None:
            order = np.argsort(token, kind="stable")
            of, ordered = np.repeat(np.arange(len(group)), [len(s.token) for s in group])[order], np.array([s.order is not None for s in group])
            if ((token[order][1:] == token[order][:-1]) & ((of[1:] != of[:-1]) | ordered[of[1:]])).any():
                places = pa.concat_arrays([_places(s.token) if s.order is None else s.order for s in group])
                texts = pa.concat_arrays([s.values.take(pa.array(s.code)) for s in group])
                order = np.lexsort((*(pc.rank(x, tiebreaker="dense").to_numpy() for x in (texts, places)), token))
            token, code = token[order], code[order]
        parts.append((token, code, np.bincount(token, minlength=n)))
        size += parts[-1][2]
    first = np.append(0, np.cumsum(size))
    out, base = np.empty(first[-1], np.int64), first[:-1].copy()
    for token, code, m in parts:
        out[(base - (np.cumsum(m) - m))[token] + np.arange(len(token))] = code
        base += m
    return Streams(first, out, pa.concat_arrays([v for _, v in pool.values()]) if pool else pa.array([], pa.string()))


# --- documents ------------------------------------------------------------------------------------------------------

_JSON = {i: f"\\u{i:04x}" for i in range(0x20)} | {ord(a): b for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))}


def quoted(a: pa.Array) -> pa.Array:
    """JSON strings."""
    odd = pc.match_substring_regex(a, '["\\\\\\x00-\\x1f]')
    if pc.any(odd).as_py():
        some = a.filter(odd)
        if pc.any(pc.match_substring_regex(some, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")).as_py():
            some = pa.array([x.translate(_JSON) for x in some.to_pylist()], pa.string())
        else:
            for char in '\\"\n\r\t':
                some = pc.replace_substring(some, char, _JSON[ord(char)])
        a = pc.replace_with_mask(a, odd, some)
    return glue('"', a, '"')


def stream_json(s: Streams, of_text: np.ndarray) -> pa.Array:
    """The JSON of each text's stream, without its brackets; of_text: tokens before each text."""
    return local.gathered(glue("[", s.joined(",", quoted(s.values)), "]"), of_text, ",")


def layers(t: Tokens, morpho: list[Layer], relations: list[Relations], sentences: Spans) -> list[set[tuple[int, str]]]:
    """Of each text (rank, layer), as ``index.layer_infos`` and ``index.structure_layers`` have them."""
    out: list[set] = [set() for _ in range(len(t.ids))]
    for text in np.unique(sentences.text).tolist():
        out[text].add((0, "dereko/s=spans"))
    given = lambda c: pc.fill_null(pc.not_equal(c, "_"), False).to_numpy(zero_copy_only=False)
    for m in morpho:
        if (pre := prefix(m.foundry)) is None or not len(m.code):
            continue
        has = {c: given(v) for c, v in m.cells.items()}
        upos = has.get("upos", np.zeros(1, bool))
        kinds = {"l": has["lemma"], "p": has["xpos"] | upos, "m": has["feats"], **({"u": upos} if m.foundry != "tree_tagger" else {}), **{c: has[c] for c in index.EXTRA if c in has}}
        for k, mask in kinds.items():
            for text in np.unique(m.text[mask[m.code]]).tolist():
                out[text].add((4, f"{pre}/{k}=tokens"))
    for r in relations:
        if (pre := prefix(r.foundry)) is not None and len(r.code):
            for text in np.unique(r.text[given(r.labels)[r.code]]).tolist():
                out[text].add((4, f"{pre}/d=rels"))
    return out


@functools.lru_cache(1 << 12)
def summary(rows: frozenset[tuple[int, str]]) -> tuple[str, str]:
    """(layer_infos, foundries), as ``index.layer_summary``."""
    words = set()
    for rank, layer in rows:
        f, kind = layer.split("/")[:2]
        name = "treetagger" if f == "tt" else f
        if rank == 0:
            words |= {(0, "", i, w) for i, w in enumerate(index.STRUCTURE_PARTS)}
        elif rank in (2, 3):
            words |= {(1, f, 0, f), (1, f, 1, f"{f}/sentences") if rank == 2 else (1, f, 2, f"{f}/structure")}
        elif rank == 4:
            words |= {(2, f, 0, name), (2, f, 1, f"{name}/dependency") if kind.startswith("d=") else (2, f, 2, f"{name}/morpho")}
    return " ".join(x[1] for x in sorted(rows)), " ".join(x[3] for x in sorted(words))


def documents(t: Tokens, texts: pa.Array, fields: pa.Array, layer_rows: list[set], s: Streams, envelope: str = "") -> tuple[np.ndarray, pa.Array]:
    """(texts that have tokens, the index document of each), as ``index.documents``. fields: the JSON of each text's, without brackets."""
    kept = np.flatnonzero((np.diff(t.first) > 0) & pc.is_valid(fields).to_numpy(zero_copy_only=False) & pc.is_valid(t.ids).to_numpy(zero_copy_only=False))
    at = pa.array(kept)
    infos, foundries = (pa.array(x, pa.string()) for x in (zip(*(summary(frozenset(layer_rows[i])) for i in kept.tolist())) if len(kept) else ((), ())))
    stream = stream_json(s, t.first).take(at)
    return kept, glue("{" + envelope + '"fields":[', fields.take(at), '],"data":{"text":', quoted(texts.take(at)), ',"layerInfos":', quoted(infos), ',"foundries":', quoted(foundries), ',"name":"tokens","stream":[', stream, "]}}")


@dataclass
class Read:
    """Documents read back. token_first: tokens before each document; first: annotations before each token; ranges: places of members
    of their data."""

    json: list[str]
    fields: list[list[dict]]
    data: list[dict]
    ranges: list[dict[str, tuple[int, int]]]
    token_first: np.ndarray
    first: np.ndarray
    values: pa.Array

    def sigle(self, i: int) -> str | None:
        return next((f.get("value") for f in self.fields[i] if f.get("key") == "textSigle"), None)


_DECODE = JSONDecoder().raw_decode
_MORE, _TAIL = re.compile(r'\]\s*,\s*"'), re.compile(r"\s*\}\s*\}\s*")


def _members(text: str, at: int):
    """(key, start) of each member of the JSON object that starts at ``at``; the end of its value is to be sent back."""
    at = _space(text, at) + 1
    while text[at := _space(text, at)] != "}":
        if text[at] == ",":
            at = _space(text, at + 1)
        key, at = scanstring(text, at + 1, True)
        at = yield key, _space(text, _space(text, at) + 1)


def _stream_end(text: str, start: int) -> int:
    """Behind the stream. It is the last array of most documents, so it need not be decoded to find its end."""
    end = text.rfind("]") + 1
    return end if _TAIL.fullmatch(text, end) and not _MORE.search(text, start) else _DECODE(text, start)[1]


def _walk(text: str) -> tuple[list[dict], dict, dict]:
    fields, data, ranges = [], {}, {}
    top, end = _members(text, 0), None
    while True:
        try:
            key, at = top.send(end)
        except StopIteration:
            return fields, data, ranges
        if key != "data" or text[at] != "{":
            value, end = _DECODE(text, at)
            if key == "fields":
                fields = value
            continue
        inner, stop = _members(text, at), None
        while True:
            try:
                k, start = inner.send(stop)
            except StopIteration:
                break
            if k == "stream":
                stop = _stream_end(text, start)
            else:
                data[k], stop = _DECODE(text, start)
            ranges[k] = (start, stop)
        end = _space(text, stop if stop is not None else at + 1) + 1


def read_documents(docs: pa.Array) -> Read:
    """As ``merge.read_documents``."""
    text = docs.to_pylist()
    fields, data, ranges = map(list, zip(*map(_walk, text))) if text else ([], [], [])
    lines = ['{"s":' + d[slice(*r["stream"])].replace("\n", " ") + "}" if "stream" in r else '{"s":[]}' for d, r in zip(text, ranges)]
    if not lines:
        return Read([], [], [], [], np.zeros(1, np.int64), np.zeros(1, np.int64), pa.array([], pa.string()))
    raw = "\n".join(lines).encode()
    schema = pa.schema({"s": pa.list_(pa.list_(pa.string()))})
    found = pyarrow.json.read_json(io.BytesIO(raw), pyarrow.json.ReadOptions(use_threads=False, block_size=len(raw) + 16), pyarrow.json.ParseOptions(explicit_schema=schema)).column("s").combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    tokens = found.flatten()
    ends = lambda x: np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64)))
    return Read(text, fields, data, ranges, ends(found), ends(tokens), tokens.flatten())


def digests(a: pa.Array) -> pa.Array:
    """md5 of each string, in hexadecimal digits."""
    at, data = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].tolist(), memoryview(a.buffers()[2] or b"")
    return pa.array([hashlib.md5(data[i:j]).hexdigest() for i, j in zip(at, at[1:])], pa.string())


# --- update ---------------------------------------------------------------------------------------------------------


def parsed(r: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(token, class, owner by number, owners' names) of a document's annotations, as ``index.parse_streams`` tells them."""
    values, n = r.values, len(r.values)
    token = np.repeat(np.arange(len(r.first) - 1), np.diff(r.first))
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n] if n else np.zeros(0, np.int32)
    data = np.append(np.frombuffer(values.buffers()[2] or b"", np.uint8), [0, 0])
    a, b = data[at], data[at + 1]
    has = lambda x, y: (a == ord(x)) & (b == ord(y))
    true = lambda f, where: where[f(values.take(pa.array(where))).to_numpy(zero_copy_only=False)]
    kind = np.full(n, FOUNDRY)
    back = has("<", ":")
    kind[true(lambda v: pc.match_substring(v, "$<b>32"), np.flatnonzero(back))] = INVERSE
    spans_at = has("<", ">")
    kind[spans_at | has("@", ":")] = SPANS
    kind[has("-", ":")] = COUNTS
    kind[true(lambda v: pc.match_substring_regex(v, r"^_[0-9]+\$"), np.flatnonzero(a == ord("_")))] = OFFSETS
    kind[true(lambda v: pc.equal(v, "base/p:_"), np.flatnonzero((a == ord("b")) & (b == ord("a"))))] = NONWORD
    kind[has("i", ":")], kind[has("s", ":")] = LOWER, SURFACE
    code, names = np.zeros(n, np.int64), {"": 0}
    for k in np.unique(kind).tolist():
        where = np.flatnonzero(kind == k)
        if k in (OFFSETS, LOWER, SURFACE, NONWORD):
            code[where] = names.setdefault("base" if k == NONWORD else "", len(names))
            continue
        pattern = {COUNTS: "^-:(?P<o>[^/$]+)/", SPANS: "^<>:(?P<o>[^/]+)/"}.get(k, "^(?:[<>]:)?(?P<o>[^/:]+)/")
        held = where
        if k == SPANS:  # an attribute is of the span before it
            held = np.maximum.accumulate(np.where(spans_at, np.arange(n), 0))[where]
        owner = pc.fill_null(pc.struct_field(pc.extract_regex(values.take(pa.array(held)), pattern), "o"), "").dictionary_encode()
        found = ["" if k == COUNTS and x in index.STRUCTURE else x for x in owner.dictionary.to_pylist()]
        code[where] = np.array([names.setdefault(x, len(names)) for x in found])[owner.indices.to_numpy()]
    return token, kind, code, list(names)


def _rank(layer: str) -> int:
    return 0 if layer == "dereko/s=spans" else 1 if layer == "base/p=tokens" else 2 if layer.endswith("/s=spans") else 3 if layer.endswith("/c=spans") else 4


def merge(docs: pa.Array, new: list[Source], token_first: np.ndarray, new_layers: list[set[tuple[int, str]]]) -> pa.Array:
    """Documents after an update of foundries: a supplied foundry replaces all of its own, all else stays byte for byte.

    new: annotations of the documents' tokens, of class foundry; token_first: tokens before each document, as ``new`` counts them;
    new_layers: (rank, layer) of the supplied foundries by document. Annotations that stay keep their order."""
    if any(s.kind != FOUNDRY for s in new):
        raise ValueError("only annotations of a foundry's own class are merged here; see merge.merge for others")
    r = read_documents(docs)
    if not np.array_equal(r.token_first, token_first):
        raise ValueError("an update of other tokens than the documents have")
    n = len(r.first) - 1
    of = np.repeat(np.arange(len(r.json)), np.diff(token_first))
    supplied: dict[str, np.ndarray] = {}
    for s in new:
        mask = supplied.setdefault(s.owner, np.zeros(len(r.json), bool))
        mask[of[s.token]] = True
    token, kind, owner, names = parsed(r)
    stays = np.ones(len(token), bool)
    for o, mask in supplied.items():
        if o in names:
            stays &= ~((owner == names.index(o)) & mask[of[token]])
    kept = []
    for k in np.unique(kind).tolist():
        for o in np.unique(owner[kind == k]).tolist() if k == FOUNDRY else [None]:
            at = np.flatnonzero(stays & (kind == k) & (True if o is None else owner == o))
            kept.append(Source(k, "" if o is None else names[o], token[at], r.values, at))
    stream = stream_json(streams(n, kept + new), token_first).to_pylist()
    out = []
    for i, old in enumerate(r.json):
        owners = {o for o, mask in supplied.items() if mask[i]}
        if not owners or "stream" not in r.ranges[i]:
            out.append(old)
            continue
        rows = {(_rank(x), x) for x in (r.data[i].get("layerInfos") or "").split(" ") if x and x.split("/")[0] not in owners} | new_layers[i]
        infos, foundries = quoted(pa.array(summary(frozenset(rows)), pa.string())).to_pylist()
        parts = {"stream": f"[{stream[i]}]", "layerInfos": infos, "foundries": foundries}
        made, at = [], 0
        for (a, b), v in sorted((r.ranges[i][k], v) for k, v in parts.items() if k in r.ranges[i]):
            made += [old[at:a], v]
            at = b
        out.append("".join([*made, old[at:]]))
    return pa.array(out, pa.string())
