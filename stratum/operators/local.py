"""Layers of whole texts as flat Arrow and numpy arrays, for queries whose layers all come from the text itself.

A slice of texts is tokenised, annotated, aligned and written in one task: nothing is exchanged, sorted or stored on the way,
so disk does not grow with the input. Strings are made once for each distinct word or reading of a slice, and taken by their
codes. Each row is a text of its own; layers that lie elsewhere are joined by the operators of ``align`` and ``index``.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources import documents

#: Bytes of text that are handled at once; a longer text stands alone.
STEP = 1 << 18


def each(texts: DataFrame, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, columns: tuple[str, ...] = ("text_id", "text"), step: int | None = None) -> DataFrame:
    """``run`` of slices of ``texts``. Its results need no exchange."""

    def batches(found):
        for batch in found:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (step or STEP), side="right")))
                yield from run(batch.slice(at, end - at))
                at = end

    return texts.select(*columns).mapInArrow(batches, schema)


def strings(a: np.ndarray) -> pa.Array:
    return pa.array(a).cast(pa.string())


def glue(*parts) -> pa.Array:
    """Strings side by side, one after another."""
    return pc.binary_join_element_wise(*parts, "")


def gathered(values: pa.Array, first: np.ndarray, separator: str = "") -> pa.Array:
    """Values joined by group; first: where each group starts, and the end of the last."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values), separator)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end of the last."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = functools.reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    return np.append(np.flatnonzero(new), n)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... of lengths[i] each, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class Spans:
    """Spans of texts, by the number of the text in its slice."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class Tokens(Spans):
    """idx: number in the text; sent: sentence in the text; first: tokens before each text; code: word among ``words``."""

    ids: pa.Array
    idx: np.ndarray
    sent: np.ndarray
    first: np.ndarray
    code: np.ndarray
    words: pa.Array

    @property
    def surface(self) -> pa.Array:
        return self.words.take(pa.array(self.code))


@dataclass
class Layer(Spans):
    """Annotation of spans: ``code`` is the number of a span's reading among ``cells``. Of repeated spans the last counts."""

    foundry: str
    code: np.ndarray
    cells: dict[str, pa.Array]


@dataclass
class Relations(Spans):
    """Relations of spans to spans, with the label's number among ``labels``."""

    foundry: str
    code: np.ndarray
    labels: pa.Array
    head_start: np.ndarray
    head_end: np.ndarray


def tokens(batch: pa.RecordBatch) -> Tokens:
    """Of (text_id, text, ...); a null text has none."""
    c = documents.cut(pc.fill_null(batch.column("text"), ""))
    bounds = np.append(c["byte_at"], len(c["data"]))
    words = pa.py_buffer(c["data"][np.repeat(c["kind"] != 0, np.diff(bounds))])
    at = np.append(0, np.cumsum(bounds[c["end"]] - bounds[c["start"]])).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), words).dictionary_encode()
    n = np.diff(c["first"])
    text, base = np.repeat(np.arange(len(n)), n), np.repeat(c["text_at"][:-1], n)
    idx = np.arange(len(text)) - np.repeat(c["first"][:-1], n)
    own = [x.astype(np.int32) for x in (c["start"] - base, c["end"] - base, idx, c["sent"])]
    return Tokens(text, own[0], own[1], batch.column("text_id"), own[2], own[3], c["first"], coded.indices.to_numpy(), coded.dictionary)


def sentences(t: Tokens) -> tuple[Spans, np.ndarray]:
    """(their spans, the first token of each and the end of the last). A text's sentences follow one another, numbered from 0."""
    at = runs(t.text, t.sent)
    return Spans(t.text[at[:-1]], t.start[at[:-1]], t.end[at[1:] - 1]), at


def find(of: Spans, among: Spans) -> np.ndarray:
    """The last of ``among`` with exactly the span of each, else -1."""
    if not len(of.text) or not len(among.text):
        return np.full(len(of.text), -1)
    size = int(max(of.end.max(), among.end.max(), of.start.max(), among.start.max())) + 1
    key = lambda s: (s.text.astype(np.int64) * size + s.start) * size + s.end
    a, b = key(of), key(among)
    order = None
    if (b[1:] <= b[:-1]).any():
        order = np.argsort(b, kind="stable")
        b = b[order]
    elif len(a) == len(b) and (a == b).all():
        return np.arange(len(a))
    at = np.searchsorted(b, a, side="right") - 1
    found = (at >= 0) & (b[np.maximum(at, 0)] == a) & (of.start >= 0) & (of.end >= of.start)
    return np.where(found, at if order is None else order[np.maximum(at, 0)], -1)


# --- made layers ----------------------------------------------------------------------------------------------------


def rule_foundry(t: Tokens) -> Layer:
    """As ``documents.rule_foundry``: one reading per token."""
    w = t.words
    card, word, upper = (pc.match_substring_regex(w, p) for p in ("^[0-9]+$", r"[\pL\pN_]", r"^\p{Lu}"))
    kind = lambda a, b, c, d: pc.if_else(card, a, pc.if_else(pc.invert(word), b, pc.if_else(upper, c, d)))
    feats = glue("Len=", pc.utf8_length(w).cast(pa.string()), pc.if_else(upper, "|Case=Up", "|Case=Low"))
    cells = {"lemma": pc.if_else(pc.equal(w, "|"), "--", pc.utf8_lower(w)), "upos": kind("NUM", "PUNCT", "NOUN", "X"), "xpos": kind("CARD", "$.", "NN", "XY"), "feats": feats, "misc": pa.nulls(len(w), pa.string())}
    return Layer(t.text, t.start, t.end, "rule", t.code, cells)


def alt_foundry(t: Tokens) -> Layer:
    """As ``documents.alt_foundry``: two readings on each third token."""
    w = t.words
    third = (t.idx % 3 == 0) & pc.not_equal(w, "|").to_numpy(zero_copy_only=False)[t.code] if len(w) else np.zeros(0, bool)
    used, code = np.unique(t.code[third], return_inverse=True)
    w = w.take(pa.array(used))
    even, low, none = pc.equal(pc.bit_wise_and(pc.utf8_length(w), 1), 0), pc.utf8_lower(w), pa.nulls(len(w), pa.string())
    cells = {"lemma": glue(low, "|", low, pc.if_else(even, "", "x")), "upos": none, "xpos": pa.repeat("ADV|KON", len(w)), "feats": none, "misc": pc.if_else(even, "0.784759|0.215241", "0.2|0.8")}
    return Layer(t.text[third], t.start[third], t.end[third], "alt", code, cells)


def dependencies(t: Tokens) -> Relations:
    """As ``documents.dependencies``: a token depends on the one before it in its sentence, the first on the sentence's span."""
    s, at = sentences(t)
    goal = np.arange(len(t.text)) - 1
    head_start, head_end, code = t.start[goal], t.end[goal], np.zeros(len(goal), np.int32)
    head_start[at[:-1]], head_end[at[:-1]], code[at[:-1]] = s.start, s.end, 1
    return Relations(t.text, t.start, t.end, "dep", code, pa.array(["nk", "root"]), head_start, head_end)


# --- alignment ------------------------------------------------------------------------------------------------------


def scan(t: Spans, idx: np.ndarray, ends: Spans, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sent, id) of tokens by ``align.sentence_scan`` and ``align.token_ids``."""
    if not len(t.text):
        return idx, idx
    size = int(max(t.start.max(), ends.end.max())) + 2
    marks = np.sort(ends.text * size + ends.end)
    before = np.searchsorted(marks, np.arange(int(t.text.max()) + 2) * size)
    passed = np.searchsorted(marks, t.text * size + t.start, side="left" if strict else "right") - before[t.text]
    n = np.diff(before)[t.text]
    passed = np.minimum(passed, np.maximum(n - 1, 0)) if strict else np.where(passed >= n, 1 << 31, passed)
    low = np.minimum.accumulate(passed - idx - (t.text << 33)) + (t.text << 33)
    sent = idx + np.minimum(1, low)
    at = runs(t.text, sent)
    return sent.astype(np.int32), (np.arange(len(sent)) - np.repeat(at[:-1], np.diff(at)) + 1).astype(np.int32)


def heads(t: Tokens, r: Relations) -> tuple[np.ndarray, np.ndarray]:
    """(relation of each token, or -1; of each relation the token with its head's span, or -1)."""
    return find(t, r), find(Spans(r.text, r.head_start, r.head_end), t)


def taken(values: pa.Array, at: np.ndarray, default: str | None = None) -> pa.Array:
    """Values by number; -1 gives ``default``."""
    out = values.take(pa.array(at, mask=at < 0)) if (at < 0).any() else values.take(pa.array(at))
    return out if default is None else pc.fill_null(out, default)


def made(layer: Layer, make: Callable, *columns: str) -> list:
    """``make`` of each distinct reading."""
    n = len(next(iter(layer.cells.values())))
    given = [c in layer.cells and layer.cells[c].null_count < n for c in columns]
    return list(map(make, *(layer.cells[c].to_pylist() if some else itertools.repeat(None, n) for c, some in zip(columns, given))))


# --- readings, as in ``rank`` ---------------------------------------------------------------------------------------


def _number(x: str) -> float | None:
    try:
        return float(x)
    except ValueError:
        return None


def _by_certainty(values: list[str], numbers: list[float | None]) -> list[tuple]:
    rows = [(None if i >= len(numbers) or numbers[i] is None else -numbers[i], i, v) for i, v in enumerate(values)]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0.0, x[1]))


def certainties(misc: str) -> list[float]:
    return [n for x in misc.split("|") if not x.startswith("Offset=") and (n := _number(x)) is not None]


def sorted_pos(xpos: str, misc: str) -> str:
    v, n = xpos.split("|"), certainties(misc)
    return "|".join(x[2] for x in _by_certainty(v, n)) if len(v) == len(n) > 1 else xpos


def sorted_misc(xpos: str, misc: str) -> str:
    n = certainties(misc)
    return "|".join(f"{-x[0]:.3f}" for x in _by_certainty(xpos.split("|"), n)) if len(xpos.split("|")) == len(n) else misc


def sorted_lemma(lemma: str, xpos: str | None, misc: str) -> str:
    v, n = list(dict.fromkeys(lemma.split("|"))), certainties(misc)
    if len(v) == len(n) > 1 and xpos is not None and len(xpos.split("|")) == len(n):
        v = [x[2] for x in _by_certainty(v, n)]
    return "|".join(v)


@functools.lru_cache(1 << 17)
def _conllu_cells(lemma, upos, xpos, feats, misc) -> tuple[str, str]:
    """Lemma to features of a line, and its last cell, as ``formats.conllu_rows`` has them."""
    last = misc
    if misc is not None:
        several = xpos is not None and "|" in xpos
        plain = re.fullmatch("[0-9.]+", misc)
        last = None if plain and not several else sorted_misc(xpos, misc) if xpos is not None and certainties(misc) else misc
        lemma = None if lemma is None else sorted_lemma(lemma, xpos, misc)
        xpos = None if xpos is None else sorted_pos(xpos, misc)
    elif lemma is not None and "|" in lemma:
        lemma = "|".join(dict.fromkeys(lemma.split("|")))
    cell = lambda c: "_" if c is None else c
    return "\t".join(map(cell, (lemma, upos, xpos, feats))), cell(last)


# --- text formats ---------------------------------------------------------------------------------------------------


def attribute_lines(t: Tokens, attrs: Spans, pos: np.ndarray, lines: pa.Array) -> pa.Array:
    """Of each token the lines before it, ended by line feeds: a line stands before the first token that starts at or after ``attrs``."""
    size = int(max(t.start.max(initial=0), attrs.start.max(initial=0))) + 1
    at = np.searchsorted(t.text * size + t.start, attrs.text * size + attrs.start)
    kept = at < np.append(t.first, len(t.text))[attrs.text + 1]
    order = np.lexsort((pos, attrs.start, at))
    order = order[kept[order]]
    first = np.searchsorted(at[order], np.arange(len(t.text) + 1))
    return gathered(glue(lines.take(pa.array(order)), "\n"), first)


def conllu(t: Tokens, morpho: Layer, r: Relations, foundry: str, attributes: pa.Array | None = None, trees: pa.Array | None = None, metadata: pa.Array | None = None) -> pa.Array:
    """Each text as CoNLL-U, as ``formats.conllu_texts`` has it; of a text without tokens the header alone. attributes: of each token;
    trees: brackets of each sentence; metadata: of each text."""
    s, s_at = sentences(t)
    sent, number = scan(t, t.idx, s)
    form = pc.replace_substring_regex(t.words, "[\t\n\r]", " ")
    form = pc.if_else(pc.equal(pc.utf8_trim(form, " "), ""), "_", form)
    read = made(morpho, _conllu_cells, "lemma", "upos", "xpos", "feats", "misc")
    at = find(t, morpho)
    code = np.where(at < 0, -1, morpho.code[at]) if len(morpho.code) else at
    rel, goal = heads(t, r)
    head = np.where(goal < 0, 0, t.idx[goal] + 1)[rel] if len(goal) else rel
    body = glue(
        strings(number), "\t", taken(form, t.code), "\t", taken(pa.array([x[0] for x in read], pa.string()), code, "_\t_\t_\t_"), "\t", taken(strings(head.astype(np.int32)), np.where(rel < 0, -1, np.arange(len(rel))), "_"), "\t",
        taken(r.labels, np.where(rel < 0, -1, r.code[rel]) if len(r.code) else rel, "_"), "\t_\t", taken(pa.array([x[1] for x in read], pa.string()), code, "_"), "\n",
    )
    lines = body if attributes is None else glue(attributes, body)
    # sentences of the scan, each with the end of its own span where it has one
    run = runs(t.text, sent)
    text, k = t.text[run[:-1]], sent[run[:-1]]
    before = np.searchsorted(s.text, np.arange(len(t.ids) + 1))
    own = before[text] + k
    own = np.where(own < before[text + 1], own, -1)
    last = np.maximum.reduceat(t.end, run[:-1]) if len(text) else t.end
    limit = np.where(own < 0, last, s.end[own]) if len(text) else last
    inside = np.flatnonzero(t.end <= np.repeat(limit, np.diff(run)))
    listed = np.searchsorted(inside, run)
    offsets = lambda x, lead: pc.binary_join_element_wise(strings(lead), gathered(strings(x[inside]), listed, " "), " ")
    begin = np.minimum.reduceat(t.start, run[:-1]) if len(text) else t.start
    parts = ["# start_offsets = ", offsets(t.start, begin), "\n# end_offsets = ", offsets(t.end, limit), "\n"]
    if trees is not None:
        shown = taken(trees, own, "")
        parts.append(pc.if_else(pc.equal(pc.utf8_trim(shown, " "), ""), "", glue("# constituency = ", shown, "\n")))
    if metadata is not None:
        told = taken(metadata, np.where(k == 0, text, -1))
        parts.append(pc.fill_null(glue("# metadata=", told, "\n"), ""))
    blocks = glue(*parts, gathered(lines, run), "\n")
    layer = "base/tokens.xml" if foundry == "base" else f"{foundry}/morpho.xml"
    name = pc.replace_substring_regex(t.ids, "[_.]", "/")
    return glue(f"# foundry = {foundry}\n# filename = ", name, f"/{layer}\n# text_id = ", t.ids, "\n", gathered(blocks, np.searchsorted(text, np.arange(len(t.ids) + 1))))


def parse_conllu(contents: pa.Array, foundry: str | None = None, strict: bool = True) -> pa.RecordBatch:
    """As ``conllu.parse``, of whole files: (text_id, foundry, sent_idx, id, form, lemma, ..., misc, from, to)."""
    split = pc.split_pattern(pc.replace_substring(contents, "\r\n", "\n") if pc.any(pc.match_substring(contents, "\r\n")).as_py() else contents, "\n")
    line = split.flatten()
    file = np.repeat(np.arange(len(contents)), pc.fill_null(pc.list_value_length(split), 0).to_numpy())
    n, file_at = len(line), np.searchsorted(file, np.arange(len(contents) + 1))
    comments = np.flatnonzero(pc.starts_with(line, "# ").to_numpy(zero_copy_only=False))
    noted = line.take(pa.array(comments))

    def tagged(k: str) -> tuple[np.ndarray, pa.Array]:
        has = pc.starts_with(noted, f"# {k} = ")
        return comments[has.to_numpy(zero_copy_only=False)], pc.utf8_trim(pc.utf8_slice_codeunits(noted.filter(has), len(k) + 5), " ")

    def holding(at: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The last of ``at`` up to each line ``where`` of the same file, else -1."""
        i = np.searchsorted(at, where, side="right") - 1
        return np.where((i >= 0) & (at[np.maximum(i, 0)] >= file_at[file[where]]), i, -1) if len(at) else np.full(len(where), -1)

    ids, id_of = tagged("text_id")
    names, name_of = tagged("foundry")
    starts, start_of = tagged("start_offsets")
    ends, end_of = tagged("end_offsets")
    count = lambda at, where: np.searchsorted(at, where, side="right") - np.searchsorted(at, file_at[file[where]])
    tokens_at = np.flatnonzero(pc.match_substring_regex(line, "^[0-9]+\t").to_numpy(zero_copy_only=False))
    cells = pc.split_pattern(line.take(pa.array(tokens_at)), "\t")
    wide = pc.greater_equal(pc.list_value_length(cells), 10)
    tokens_at, cells = tokens_at[wide.to_numpy(zero_copy_only=False)], cells.filter(wide)
    flat, cell_at = cells.flatten(), np.append(0, np.cumsum(pc.list_value_length(cells).to_numpy()))[:-1].astype(np.int64)
    cell = lambda i: flat.take(pa.array(cell_at + i))
    digits = pc.replace_substring_regex(cell(0), "^0+([0-9])", r"\1")
    short = pc.if_else(pc.less_equal(pc.binary_length(digits), 9), digits, "999999999")  # a longer number is no place in a list
    number = short.cast(pa.int32()).to_numpy()
    block, end_block = count(starts, tokens_at), count(ends, tokens_at)
    part = np.maximum(block, end_block)

    def placed(at: np.ndarray, texts: pa.Array, other: np.ndarray) -> pa.Array:
        """The token's number of the comment that holds, if that is of the token's own part."""
        lists = pc.split_pattern_regex(texts, "[ \t\n\x0b\f\r]+")
        k = holding(at, tokens_at)
        own = np.maximum(count(at, at), count(other, at))
        size, first = pc.list_value_length(lists).to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        ok = (k >= 0) & (own[k] == part) & (number < size[k]) if len(at) else np.zeros(len(k), bool)
        values = lists.flatten()
        values = pc.if_else(pc.match_substring_regex(values, r"^[+-]?[0-9]{1,9}$"), pc.utf8_ltrim(values, "+"), None).cast(pa.int32())
        return values.take(pa.array(np.where(ok, first[:-1][k] + number if len(at) else 0, 0), mask=~ok))

    text_id = taken(id_of, holding(ids, tokens_at))
    owner = pa.repeat(foundry, len(tokens_at)) if foundry else taken(name_of, holding(names, tokens_at))
    begin, end = placed(starts, start_of, ends), placed(ends, end_of, starts)
    known = functools.reduce(pc.and_, (pc.is_valid(c) for c in (text_id, owner, begin, end)))
    if strict and not pc.all(known).as_py() and len(known):
        raise ValueError("token without text_id, foundry or offsets")
    # sentences of a file's text, numbered by their blocks
    coded = text_id.dictionary_encode().indices.fill_null(-1).to_numpy()
    order = np.lexsort((block, coded, file[tokens_at]))
    of_text = runs(file[tokens_at][order], coded[order])
    step = np.zeros(len(order), np.int64)
    step[1:] = block[order][1:] != block[order][:-1]
    step[of_text[:-1]] = 0
    step = np.cumsum(step)
    sent = np.empty(len(order), np.int32)
    sent[order] = step - np.repeat(step[of_text[:-1]], np.diff(of_text))
    empty = lambda c: pc.if_else(pc.equal(c, "_"), None, c)
    columns = {"text_id": text_id, "foundry": owner, "sent_idx": pa.array(sent), "id": pa.array(number), "form": cell(1), **{c: empty(cell(i + 2)) for i, c in enumerate(("lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"))}, "from": begin, "to": end}
    out = pa.RecordBatch.from_pydict(columns)
    return out if strict else out.filter(known)


PARSED = "text_id string, foundry string, sent_idx int, id int, form string, lemma string, upos string, xpos string, feats string, head string, deprel string, deps string, misc string, `from` int, `to` int"


def _escaped(c: str) -> str:
    return c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


@functools.lru_cache(1 << 17)
def _morpho_fs(lemma, upos, xpos, feats, misc) -> str:
    f = lambda name, v: "" if v is None or v == "_" else f'<f name="{name}">{_escaped(v)}</f>'
    alt = lambda c, i: None if c is None or i >= c.count("|") + 1 else c.split("|")[i]
    sure = lambda v: v if v is not None and _number(v) is not None else None
    one = lambda i: f'<fs type="lex"><f name="lex"><fs>{f("lemma", alt(lemma, i))}{f("upos", alt(upos, i))}{f("pos", alt(xpos, i))}{f("msd", feats if i == 0 else None)}{f("certainty", sure(alt(misc, i)))}</fs></f></fs>'
    return "".join(map(one, range((xpos or "").count("|") + 1)))


def _xml(ids: pa.Array, spans: pa.Array, text: np.ndarray) -> pa.RecordBatch:
    """(text_id, xml) of the texts that have spans."""
    at = runs(text)
    own = ids.take(pa.array(text[at[:-1]]))
    return pa.RecordBatch.from_pydict({"text_id": own, "xml": glue('<?xml version="1.0" encoding="UTF-8"?>\n<layer docid="', own, '"><spanList>', gathered(spans, at), "</spanList></layer>")})


def morpho_xml(t: Tokens, morpho: Layer) -> pa.RecordBatch:
    """As ``formats.morpho_xml``: a span per token, an ``fs`` per alternative reading."""
    at = find(t, morpho)
    fs = taken(pa.array(made(morpho, _morpho_fs, "lemma", "upos", "xpos", "feats", "misc"), pa.string()), np.where(at < 0, -1, morpho.code[at]) if len(morpho.code) else at, _morpho_fs(None, None, None, None, None))
    return _xml(t.ids, glue('<span id="t_', strings(t.idx), '" from="', strings(t.start), '" to="', strings(t.end), '">', fs, "</span>"), t.text)


def relation_spans(t: Tokens, head: np.ndarray, code: np.ndarray, ends: Spans, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Heads by number in the sentence as spans, as ``align.relation_spans``: (tokens that keep a relation, sent, id, head_start, head_end).
    ends: where the scan's sentences end; spans: those of root relations, in order; code: of labels, -1 for none."""
    sent, number = scan(t, t.idx, ends, strict=True)
    goal = t.idx - number + head
    root = head < 1
    before = np.searchsorted(spans.text, np.arange(len(t.ids) + 1))
    own = before[t.text] + sent
    whole = own < before[t.text + 1]
    n = np.diff(t.first)[t.text]
    kept = np.flatnonzero((code >= 0) & np.where(root, whole, (goal >= 0) & (goal < n)))
    at, own, root = (t.first[t.text] + goal)[kept], own[kept], root[kept]
    pick = lambda a, b: np.where(root, a[np.where(root, own, 0)], b[np.where(root, 0, at)]).astype(np.int32) if len(kept) else t.start[:0]
    return kept, sent[kept], number[kept], pick(spans.start, t.start), pick(spans.end, t.end)


def dependency_xml(t: Tokens, kept: np.ndarray, sent: np.ndarray, number: np.ndarray, deprel: pa.Array, head_start: np.ndarray, head_end: np.ndarray) -> pa.RecordBatch:
    """As ``formats.dependency_xml``, of the tokens ``kept``."""
    spans = glue('<span id="s', strings(sent + 1), "_n", strings(number), '" from="', strings(t.start[kept]), '" to="', strings(t.end[kept]), '"><rel label="', deprel, '"><span from="', strings(head_start), '" to="', strings(head_end), '"/></rel></span>')
    return _xml(t.ids, spans, t.text[kept])


# --- annotators: functions of a sentence, see ``annotate`` ----------------------------------------------------------


def tag(t: Tokens, f: Callable[[list[str]], list[tuple[str, str]]], foundry: str) -> Layer:
    """As ``annotate.tag``: lemma and part of speech of each token by a function of its sentence."""
    words, at = t.surface.to_pylist(), runs(t.text, t.sent).tolist()
    found, which = [], []
    for a, b in zip(at, at[1:]):
        said = f(words[a:b])[: b - a]
        found += said
        which += range(a, a + len(said))
    k = np.array(which, np.int64)
    lemma, xpos = zip(*found) if found else ((), ())
    return Layer(t.text[k], t.start[k], t.end[k], foundry, np.arange(len(k)), {"lemma": pa.array(lemma, pa.string()), "xpos": pa.array(xpos, pa.string())})


def parse(t: Tokens, tagged: Layer, f: Callable[[list[tuple]], list[tuple[int, str]]], foundry: str) -> Relations:
    """As ``annotate.parse``, over the tokens that are tagged: head 0 is the sentence's span, a head that no token has drops the relation."""
    at = find(t, tagged)
    k = np.flatnonzero(at >= 0)
    code = pa.array(tagged.code[at[k]]) if len(k) else pa.array([], pa.int64())
    rows = list(zip(t.surface.take(pa.array(k)).to_pylist(), tagged.cells["lemma"].take(code).to_pylist(), tagged.cells["xpos"].take(code).to_pylist()))
    first = runs(t.text[k], t.sent[k])
    said, sizes = [], []
    bounds = first.tolist()
    for a, b in zip(bounds, bounds[1:]):
        one = f(rows[a:b])[: b - a]
        said += one
        sizes.append(len(one))
    head, label = zip(*said) if said else ((), ())
    head, sizes = np.array(head, np.int64), np.array(sizes, np.int64)
    begin, n = np.repeat(first[:-1], sizes), np.repeat(np.diff(first), sizes)
    own = spread(first[:-1], sizes)
    start, end = t.start[k], t.end[k]
    low, high = (np.minimum.reduceat(start, first[:-1]), np.maximum.reduceat(end, first[:-1])) if len(k) else (start, end)
    ok = head <= n
    goal = np.where(ok & (head > 0), begin + head - 1, 0)
    head_start, head_end = (np.where(head > 0, x[goal], np.repeat(y, sizes)) if len(head) else start[:0] for x, y in ((start, low), (end, high)))
    labels = pa.array(label, pa.string()).filter(pa.array(ok, pa.bool_())).dictionary_encode()
    own = own[ok]
    return Relations(t.text[k][own], start[own], end[own], foundry, labels.indices.to_numpy(), labels.dictionary, head_start[ok].astype(np.int32), head_end[ok].astype(np.int32))


def relation_rows(ids: pa.Array, r: Relations) -> pa.RecordBatch:
    """(text_id, foundry, from, to, deprel, head_from, head_to)."""
    columns = {"text_id": ids.take(pa.array(r.text)), "foundry": pa.repeat(r.foundry, len(r.text)), "from": pa.array(r.start), "to": pa.array(r.end), "deprel": r.labels.take(pa.array(r.code)), "head_from": pa.array(r.head_start), "head_to": pa.array(r.head_end)}
    return pa.RecordBatch.from_pydict(columns)


@dataclass
class Nodes(Spans):
    """Nodes of trees; children: of each node (is a node, id)."""

    ids: list[str]
    labels: list[str]
    children: list[list[tuple[bool, str]]]


def parse_trees(t: Tokens, f: Callable[[list[str]], list[tuple[str, str, list]]]) -> Nodes:
    """As ``annotate.parse_trees``: nodes by a function of a sentence's surfaces."""
    words, at, number = t.surface.to_pylist(), runs(t.text, t.sent).tolist(), t.sent.tolist()
    starts, ends, idx, texts = t.start.tolist(), t.end.tolist(), t.idx.tolist(), t.text.tolist()
    text, start, end, ids, labels, children = [], [], [], [], [], []
    for a, b in zip(at, at[1:]):
        nodes, k = f(words[a:b]), f"s{number[a]}_"
        below = {name: kids for name, _, kids in nodes}
        for name, label, kids in nodes:
            todo, low, high = [name], None, 0  # with a stack of its own: trees may be deep
            while todo:
                for c in below.get(todo.pop(), ()):
                    if isinstance(c, int):
                        if low is None or starts[a + c] < low:
                            low = starts[a + c]
                        if ends[a + c] > high:
                            high = ends[a + c]
                    else:
                        todo.append(c)
            text.append(texts[a])
            start.append(low or 0)
            end.append(high)
            ids.append(k + name)
            labels.append(label)
            children.append([(False, f"t_{idx[a + c]}") if isinstance(c, int) else (True, k + c) for c in kids])
    return Nodes(np.array(text, np.int64), np.array(start, np.int32), np.array(end, np.int32), ids, labels, children)


def tree_depths(nodes: Nodes, levels: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, depth) as ``layers.tree_levels``: roots, which no node of their text refers to, have depth 0."""
    at, out, depths = runs(nodes.text).tolist(), [], []
    for a, b in zip(at, at[1:]):
        named: dict[str, list[int]] = {}
        for i in range(a, b):
            named.setdefault(nodes.ids[i], []).append(i)
        inner = {c for i in range(a, b) for is_node, c in nodes.children[i] if is_node}
        level, depth = [i for i in range(a, b) if nodes.ids[i] not in inner], 0
        while level:
            if depth == levels:
                raise RuntimeError(f"trees of over {levels} levels")
            out += level
            depths += [depth] * len(level)
            below = {c for i in level for is_node, c in nodes.children[i] if is_node}
            level, depth = [i for c in below for i in named.get(c, ())], depth + 1
    return np.array(out, np.int64), np.array(depths, np.int32)
