"""Suffix-array dedup by merging Burrows-Wheeler transforms of shards.

Every byte covered by a LENGTH-byte string that starts at two places is removed. Strings are dealt out by content: the
anchor of a string is its K-byte piece of the lowest hash (the leftmost, on ties), so equal strings have equal
anchors. Consecutive strings of a text with the same anchor are a run; a run's strings make up its segment.

1. Runs whose anchor occurs once in the corpus hold no repeated string. Equal segments are collapsed; if there are
   two or more, all their strings are repeated. This pre-aggregates copies, however many.
2. Different segments with the same anchor are compared. They are cut into shards, and each shard's transform is
   built over SYMBOL-byte symbols to DEPTH = LENGTH / SYMBOL symbols. The shards' transforms are merged by iterative
   interleave refinement: an interleave of shard numbers is re-sorted by the preceding symbols, round by round, which
   after h rounds has all suffixes in the order of their first h symbols; the round in which a border first shows
   gives the common prefix there. Intervals without a border after DEPTH rounds are the repeated strings.
3. An anchor with more than HOT different segments isn't compared in one task: its strings are dealt out by their
   128-bit digests and counted, which gives the same result. Before that, pieces of LENGTH - GRID + 1 bytes at every
   GRID-th place about the anchor are: a repeated string holds a repeated piece, so only strings that do are dealt out.

Passages, the same with words for bytes: a text's words in strings of PASSAGE words that start at another place too.
Words are runs of other characters than the six ASCII white-space ones, as they are.

Texts are UTF-8 bytes; null counts as empty; strings never cross documents. Repeated rows are places like others, so
all their strings are repeated. A null id is a key like any other. An empty table gives no rows. Texts of any
length are read whole, in pieces that overlap by LENGTH - 1 bytes. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, materialize, skew_safe_join, text_of
from .tokens import spread, steps


@dataclass(frozen=True)
class Unit:
    """What strings are made of: items of a string, of an anchor, of a symbol and between pieces of hot anchors."""

    words: bool
    length: int
    k: int
    symbol: int
    grid: int

    @property
    def kind(self):
        return np.dtype("<u8" if self.words else "u1")


LENGTH, PASSAGE = 400, 51
BYTES, WORDS = Unit(False, LENGTH, 32, 100, 40), Unit(True, PASSAGE, 8, 17, 5)
#: Items of text that anchors are sought in at once, and of segments compared at once and in one shard.
PIECE, GROUP, SHARD = 1 << 18, 1 << 19, 1 << 17
#: Rows whose lists are Python objects at once, and bytes of text that words are told apart in.
ROWS, STEP_BYTES = 512, 1 << 22
#: Different segments of one anchor beyond which their strings are dealt out by digest.
HOT = 3000
LOWEST = -(1 << 63)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE + 4 * LENGTH)
        up = np.full(size, _MULTIPLIER)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))
        down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k items of ``data``, by differences of a running sum."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTES[data] if data.dtype == np.uint8 else data) * up, out=total[1:])
    return _mixed((total[k:] - total[:-k]) * down[: len(data) - k + 1])


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, from minima to either side of every w-th place."""
    n = len(values) - w + 1
    padded = np.full(-(-len(values) // w) * w, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string) of each run, of texts that end at ``ends`` in ``data``."""
    if len(data) < unit.length:
        return (np.empty(0, np.int64),) * 3
    h = window_hashes(data, unit.k)
    anchor = window_minima((h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), unit.length - unit.k + 1) & np.uint64(0xFFFFFFFF)
    lengths = np.diff(ends, prepend=0)
    n = np.maximum(0, lengths - unit.length + 1)
    at = spread(ends - lengths, n)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    anchor = anchor[at].astype(np.int64)
    first = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    start = np.flatnonzero(first)
    return anchor[start], at[start], at[np.append(start[1:], len(at)) - 1]


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _word_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, offsets by text)."""
    from xxhash import xxh3_64_intdigest

    parts = pc.ascii_split_whitespace(column)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(flat):
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    own = np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) | np.uint64(1)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = np.fromiter((w != "" for w in words), bool, len(words))[codes]
    before = np.concatenate([[0], np.cumsum(real)])
    return own[codes[real]], before[np.concatenate([[0], np.cumsum(counts)])]


def _values(text: str, unit: Unit) -> np.ndarray:
    """The items of one text."""
    if not unit.words:
        return np.frombuffer(text.encode(), np.uint8)
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, text.encode().split()), np.uint64) | np.uint64(1)


def _pieces(offsets: np.ndarray, unit: Unit, size: int = PIECE):
    """Lists of (row, from, to within the text): about ``size`` items each, long texts in overlapping parts."""
    held, total = [], 0
    for i, n in enumerate(np.diff(offsets).tolist()):
        if n < unit.length:
            continue
        for at in range(0, n - unit.length + 1, size):
            to = min(n, at + size + unit.length - 1)
            held.append((i, at, to))
            total += to - at
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


_RUN_NAMES = ["key", "id", "same", "lo", "hi", "seg", "n", "at"]
_RUN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_RUN = "key long, id long, same long, lo long, hi long, seg binary, n long, at long"


def _find_runs(unit: Unit):
    """Runs of each text: hi is the end of the last string, ``at`` the anchor's place in the segment. Segments that a piece
    holds twice come once, with n = 2, and their places besides as rows without a segment: those are repeated, whatever
    else the corpus holds."""

    def run(batches):
        for batch in batches:
            ids, same, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            if not unit.words:
                yield from found(ids, same, *_raw(texts))
                continue
            for i, j in steps(texts, STEP_BYTES):
                yield from found(ids[i:j], same[i:j], *_word_values(texts.slice(i, j - i)))

    def found(ids, same, data, offsets):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for held in _pieces(offsets, unit):
            start, lo, hi = (np.array(x, np.int64) for x in zip(*held))
            own = data[spread(offsets[start] + lo, hi - lo)] if len(held) > 1 else data[offsets[start[0]] + lo[0] : offsets[start[0]] + hi[0]]
            ends = np.cumsum(hi - lo)
            anchor, first, last = runs(own, ends, unit)
            w = unit.kind.itemsize
            view = memoryview(np.ascontiguousarray(own)).cast("B")
            row = np.searchsorted(ends, first, side="right")
            shift = (lo - (ends - (hi - lo)))[row]
            a, f, e = anchor.tolist(), first.tolist(), (last + unit.length).tolist()
            seg = [xxh3_128_digest(view[w * x : w * y]) for x, y in zip(f, e)]
            count: dict[bytes, int] = {}
            for s in seg:
                count[s] = count.get(s, 0) + 1
            out, told = [], set()
            at, doc = shift.tolist(), start[row].tolist()
            for i, s in enumerate(seg):
                d, x, y = doc[i], f[i] + at[i], e[i] + at[i]
                if count[s] > 1:
                    if out and out[-1][5] is None and out[-1][8] == d and x <= out[-1][4]:
                        out[-1][4] = y
                    else:
                        out.append([0, ids[d], same[d], x, y, None, 0, 0, d])
                    if s in told:
                        continue
                    told.add(s)
                    # kept apart, so that places of one text stay next to each other
                    last_known = out.pop()
                    out += [[_signed(xxh3_64_intdigest(view[w * a[i] : w * (a[i] + unit.k)])), ids[d], same[d], x, y, s, 2, a[i] - f[i], d], last_known]
                else:
                    out.append([_signed(xxh3_64_intdigest(view[w * a[i] : w * (a[i] + unit.k)])), ids[d], same[d], x, y, s, 1, a[i] - f[i], d])
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RUN_TYPES)], _RUN_NAMES)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- transforms -------------------------------------------------------------------------------------------------


def _sorted_by(symbols: np.ndarray) -> np.ndarray:
    """The stable order of small non-negative integers, by one sort of (symbol, place)."""
    return (np.sort((symbols.astype(np.uint64) << np.uint64(32)) | np.arange(len(symbols), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Shard:
    """The transform of one shard. symbol: of each place, 0 where the segment ends sooner; has_before: whether the
    place ``step`` items earlier is in the same segment."""

    def __init__(self, symbol: np.ndarray, has_before: np.ndarray, depth: int, step: int = BYTES.symbol):
        terminal = np.flatnonzero(symbol == 0)
        order = np.arange(len(symbol))
        for _ in range(depth):  # suffixes by one more symbol: those before the suffixes in the last order
            before = order[has_before[order]] - step
            order = np.concatenate([terminal, before[_sorted_by(symbol[before])]])
        self.order, self.terminals = order, len(terminal)
        #: the symbol before each suffix, in suffix order; 0 where there is none
        self.bwt = np.where(has_before[order], symbol[order - step], 0)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave of shard numbers, common prefix in symbols with the suffix before; ``depth`` if no border showed).

    Only transforms are looked at. In each round the interleave hands out the shards' preceding symbols in its order;
    sorted by them, stably, it becomes the interleave by one more symbol."""
    n = sum(len(s.bwt) for s in shards)
    z = np.repeat(np.arange(len(shards)), [len(s.bwt) for s in shards])
    ends = np.repeat(np.arange(len(shards)), [s.terminals for s in shards])
    block, prefix = np.zeros(n, np.int64), np.full(n, depth, np.int64)
    for h in range(depth):
        c = np.empty(n, np.int64)
        for k, s in enumerate(shards):
            c[z == k] = s.bwt
        has = np.flatnonzero(c)
        perm = has[_sorted_by(c[has])]
        z = np.concatenate([ends, z[perm]])
        symbol, old = np.concatenate([np.zeros(len(ends), np.int64), c[perm]]), np.concatenate([np.zeros(len(ends), np.int64), block[perm]])
        border = np.r_[True, (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])]
        block = np.cumsum(border)
        prefix[border & (prefix == depth)] = h
    return z, prefix


def repeated(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, step: int = BYTES.symbol, shard_items: int = SHARD) -> np.ndarray:
    """Places whose ``length`` bytes start at another place too, in segments that end at ``ends`` in ``data``."""
    # an item behind each segment is the place of its empty suffix
    data = np.insert(data, ends, 0)
    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0) + 1)
    ends = ends + np.arange(1, len(ends) + 1)
    lengths = np.diff(ends, prepend=0)
    depth = length // step
    left = np.repeat(ends, lengths) - np.arange(len(data)) - 1
    symbol = np.zeros(len(data), np.int64)
    full = np.flatnonzero(left >= step)
    symbol[full] = np.unique(window_hashes(data, step)[full], return_inverse=True)[1] + 1
    has_before = np.repeat(lengths, lengths) - 1 - left >= step
    # shards of whole segments
    number = (ends - 1) // shard_items
    cuts = [0, *ends[np.flatnonzero(np.diff(number))].tolist(), len(data)]
    bases = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    shards = [Shard(symbol[a:b], has_before[a:b], depth, step) for a, b in bases]
    z, prefix = merge(shards, depth)
    place = np.empty(len(data), np.int64)
    for k, (s, (a, _)) in enumerate(zip(shards, bases)):
        place[z == k] = s.order + a
    same = prefix == depth
    if len(same):
        same[0] = False
    member = same | np.append(same[1:], False)
    found = place[member]
    found = np.sort(found[left[found] >= length])
    return found - segment[found]


def _compare(unit: Unit):
    """Removed stretches of segments, which come sorted by key; a segment fetched twice counts once."""
    import itertools

    w = unit.kind.itemsize

    def rows(batches):
        for batch in _few(batches):
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "n", "id", "same", "lo", "data")))

    def groups(batches):
        held, size = [], 0
        for _, own in itertools.groupby(rows(batches), key=lambda r: r[0]):
            own = list({r[1]: r for r in own}.values())
            if len(own) > 1:
                held += own
                size += sum(len(r[6]) // w for r in own)
            if size >= GROUP:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for held in groups(batches):
            ends = np.cumsum([len(r[6]) // w for r in held])
            found = repeated(np.frombuffer(b"".join(r[6] for r in held), unit.kind), ends, unit.length, unit.symbol)
            if not len(found):
                continue
            row = np.searchsorted(ends, found, side="right")
            first = np.flatnonzero(np.r_[True, (np.diff(found) != 1) | (np.diff(row) != 0)])
            last = np.append(first[1:], len(found)) - 1
            out = []
            for r, a, b in zip(row[first].tolist(), found[first].tolist(), found[last].tolist()):
                _, _, n, i, s, lo, d = held[r]
                if n == 1:  # others are removed as a whole
                    base = lo - int(ends[r]) + len(d) // w
                    out.append((i, s, base + a, base + b + unit.length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], _PLACE)

    return run


_PLACE = ["id", "same", "lo", "hi"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, same, t): the key of a row is its id and a hash of its text; rows that share both are alike."""
    t = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(t).alias("same"), t.alias("t"))


_CUT_NAMES = ["key", "seg", "n", "id", "same", "lo", "at", "data", "hot"]
_CUT_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
_CUT = "key long, seg binary, n long, id long, same long, lo long, at long, data binary, hot boolean"


def _few(batches):
    """Batches of ROWS rows at most."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _cut(unit: Unit):
    """The items of wanted segments of each text."""

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CUT_TYPES)], _CUT_NAMES)

    def run(batches):
        for batch in _few(batches):
            out = []
            for i, same, parts, text in zip(*(batch.column(c).to_pylist() for c in ("id", "same", "parts", "t"))):
                raw = _values(text, unit)
                out += [(p["key"], p["seg"], p["n"], i, same, p["lo"], p["at"], raw[p["lo"] : p["hi"]].tobytes(), p["hot"]) for p in parts]
                if len(out) > 5_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return run


def spans(keyed: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """(id, same, lo, hi) of stretches of repeated strings, in any order, overlapping or not; in items of the text."""
    found = materialize(keyed.filter(F.octet_length("t") >= unit.length * (2 if unit.words else 1) - 1).mapInArrow(_find_runs(unit), _RUN), "runs")
    known, own = materialize(found.filter("seg IS NULL").select(*_PLACE), "known-runs"), found.filter("seg IS NOT NULL")
    keys = own.groupBy("key").agg(F.sum("n").alias("k"), F.count(F.lit(1)).alias("rows")).filter("k > 1").select("key", "rows")
    held = materialize(skew_safe_join(own, keys, "key", "rows", found.count()).drop("rows"), "repeated-runs")
    discard(found)  # most runs' anchors occur once
    segments = materialize(held.groupBy("seg").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "same", "lo", "hi", "key", "at")).alias("f")).select("seg", "n", "rows", "f.*"), "segments")
    whole = skew_safe_join(held.select("seg", *_PLACE), segments.filter("n > 1").select("seg", "rows"), "seg", "rows", held.count()).select(*_PLACE)
    many = segments.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # keys of over HOT segments are marked here, so that no list of them is needed
    compared = skew_safe_join(segments.drop("rows"), many, "key", "m", segments.count()).select("id", "same", F.struct("lo", "hi", "key", "seg", "n", "at", (F.col("m") > HOT).alias("hot")).alias("s"))
    wanted = compared.groupBy("id", "same").agg(F.collect_list("s").alias("parts"))  # a text's length bounds them
    pieces = materialize(wanted.join(keyed, ["id", "same"]).mapInArrow(_cut(unit), _CUT), "segment-items")
    cold = pieces.filter("NOT hot").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(unit), "id long, same long, lo long, hi long")
    out = known.unionByName(whole).unionByName(cold)
    hot = pieces.filter("hot")
    if hot.isEmpty():
        return out
    return out.unionByName(_by_digest(materialize(hot.dropDuplicates(["seg"]), "hot-segments"), unit))


def _by_digest(hot: DataFrame, unit: Unit) -> DataFrame:
    """Repeated strings of segments of hot anchors, by the counts of digests: first of pieces, then of the strings that hold
    a repeated one."""
    w, piece = unit.kind.itemsize, unit.length - unit.grid + 1

    def grid(batches):
        from xxhash import xxh3_128_digest

        for batch in _few(batches):
            out = []
            for seg, at, data in zip(*(batch.column(c).to_pylist() for c in ("seg", "at", "data"))):
                # places as far from the anchor as a multiple of the grid: equal strings have them in the same places
                out += [(xxh3_128_digest(data[w * x : w * (x + piece)]), seg, x) for x in range(at % unit.grid, len(data) // w - piece + 1, unit.grid)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64()))], ["digest", "seg", "x"])

    def strings(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            for i, same, lo, n, data, places in zip(*(batch.column(c).to_pylist() for c in ("id", "same", "lo", "n", "data", "places"))):
                top = len(data) // w - unit.length
                starts = sorted({s for x in places for s in range(max(0, x - unit.grid + 1), min(x, top) + 1)})
                out += [(xxh3_128_digest(data[w * s : w * (s + unit.length)]), i, same, lo + s, n) for s in starts]
                if len(out) > 20_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), *[pa.int64()] * 4))], ["digest", "id", "same", "lo", "n"])

    def repeats(rows: DataFrame) -> DataFrame:
        counts = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "digest-counts")
        return skew_safe_join(rows, counts, "digest", "k", rows.count())

    places = repeats(materialize(hot.mapInArrow(grid, "digest binary, seg binary, x long"), "grid-pieces")).groupBy("seg").agg(F.collect_set("x").alias("places"))
    rows = materialize(hot.join(places, "seg").mapInArrow(strings, "digest binary, id long, same long, lo long, n long"), "strings")
    return repeats(rows).filter("n = 1").select("id", "same", "lo", (F.col("lo") + unit.length).alias("hi"))


def _merged(found) -> list[list[int]]:
    """Stretches that overlap or touch as one; they come sorted."""
    merged: list[list[int]] = []
    for s in found:
        if merged and s["lo"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["hi"])
        else:
            merged.append([s["lo"], s["hi"]])
    return merged


def _applied(keyed: DataFrame, digest: bool) -> DataFrame:
    """Removal on every row: (id, same, n_bytes, n_removed, n_spans, kept_sha256 or kept binary, n_passages, n_passage_words)."""
    every = spans(keyed).withColumn("words", F.lit(False)).unionByName(spans(keyed, WORDS).withColumn("words", F.lit(True)))
    of = lambda words: F.sort_array(F.collect_set(F.when(F.col("words") == words, F.struct("lo", "hi"))))
    removed = every.groupBy("id", "same").agg(of(False).alias("spans"), of(True).alias("passages"))  # a text's length bounds them
    last = "kept_sha256" if digest else "kept"

    def run(batches):
        for batch in _few(batches):
            out = []
            for i, text, found, passages in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "spans", "passages"))):
                raw = text.encode()
                kept, at, removed_bytes = [], 0, 0
                cuts, other = _merged(found or ()), _merged(passages or ())
                for lo, hi in cuts:
                    kept.append(raw[at:lo])
                    removed_bytes, at = removed_bytes + hi - lo, hi
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((None if i == LOWEST else i, len(raw), removed_bytes, len(cuts), hashlib.sha256(rest).hexdigest() if digest else rest, len(other), sum(y - x for x, y in other)))
            if out:
                types = [pa.int64()] * 4 + [pa.string() if digest else pa.binary()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", last, "n_passages", "n_passage_words"]
    kinds = ["long"] * 4 + ["string" if digest else "binary"] + ["long"] * 2
    return keyed.join(removed, ["id", "same"], "left").select("id", "t", "spans", "passages").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, n_passages, n_passage_words): what is left of every row; a cut may
    fall inside a character. Passages are counted in the input: maximal stretches of words, and their words."""
    return _applied(_keyed(docs, id_col, text_col), digest=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(_keyed(documents(spark, sf_dir), "doc_id", "text"), digest=True)
