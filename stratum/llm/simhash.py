"""SimHash near-dedup with a binary trie self-join.

Equal fingerprints are one class from the start. Two fingerprints at most K bits apart agree on one of K + 1 blocks of
bits, so each class enters one bucket for each block; a bucket with more than SPLIT classes is dealt out again by
the blocks of its other bits, level by level, which keeps every link. Tasks read buckets one after another. In a bucket the sorted fingerprints are a binary trie. Pairs of
nodes go down it together: differing bits are summed, and a pair over the budget of K is dropped with all below it.
A bucket gives a spanning forest of its links, not all pairs; components then follow from all forests.

Null and empty texts have no words: fingerprint zero, linked like any other. Texts of fewer words than a shingle are
one shingle. Repeated rows share a component, and a null id is in its component but never names one (a component of
null ids alone has a null name). An empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import documents, materialize, skew_safe_join, text_of

WORDS, K, SEED, BITS = 3, 2, 42, 64
#: For similarity of five-word shingles: the budget holds 3.5 standard deviations of a pair at 0.8; bins of a signature,
#: whose estimate at 0.8 has a deviation of 0.0125 at most, and the estimate that counts; minima by which candidates meet.
SIMILAR_WORDS, SIMILAR_K, BINS, ESTIMATE, MINIMA = 5, 20, 1024, 0.79, 4
#: Classes of a bucket beyond which it is dealt out by further blocks.
SPLIT = 5_000
#: Levels of blocks: 64 bits leave 8 after five of thirds, and a bucket of 256 fingerprints at most.
LEVELS = 5
#: Rows of buckets that a task holds at once, without and with signatures, besides the rest of the last bucket.
ROWS, SIGNED_ROWS = 1 << 16, 1 << 13
#: Node pairs handled at once; a level of the trie keeps four times as many waiting at most.
PAIRS = 1 << 15


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of one text."""
    import xxhash

    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    if not shingles:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(h)).tobytes(), "big")


def _fingerprints(texts: list[str], words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        w = text.encode().lower().split()  # bytes: only A-Z, and only the six white-space bytes
        n = len(w) - words + 1
        if n < 1:
            if w:
                out[i] = xxh64_intdigest(b" ".join(w), SEED)
            continue
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(w[k:] for k in range(words))))), ">u8", n)
        count = np.zeros(64, np.int64)
        for at in range(0, n, 4096):
            count += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint16)
        out[i] = np.packbits(count * 2 > n).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long, same long): fp holds the 64 bits, same a hash of the text that tells repeated ids apart."""

    def run(batches):
        for batch in batches:
            fp = _fingerprints(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "same"])

    t = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("__text"), F.xxhash64(t).alias("same")).mapInArrow(run, "doc_id long, fp long, same long")


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in n blocks of nearly equal size."""
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits (63: highest) of each fingerprint, side by side."""
    out = np.zeros(len(fp), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((fp >> np.uint64(b)) & np.uint64(1))
    return out


def trie_pairs(bucket: np.ndarray, fp: np.ndarray, k: int = K):
    """Batches (i, j) of all pairs of rows in the same bucket that differ in at most ``k`` bits.

    Rows must be sorted by (bucket, fp); rows of equal fp are pairs too. A node is a range of rows that share their first
    bits; the frontier of node pairs is an array, and one bit is taken at a time for all of it."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    many = ends - starts > 1
    stack = [(BITS - 1, np.stack([starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int64)]).astype(np.int32))]
    while stack:
        bit, pairs = stack.pop()
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > PAIRS:  # the rest waits: memory stays bounded
            stack.append((bit, pairs[:, PAIRS:].copy()))
            pairs = pairs[:, :PAIRS].copy()
        small = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        if small.any() or bit < 0:
            leaf = pairs[:, small]
            leaf = leaf[:, leaf[0] != leaf[2]]
            near = np.bitwise_count(fp[leaf[0]] ^ fp[leaf[2]]) <= k
            if near.any():
                yield leaf[0][near], leaf[2][near]
            pairs = pairs[:, ~small]
            if bit < 0 or not pairs.shape[1]:
                yield from _products(pairs)
                continue
        lo1, hi1, lo2, hi2, used = pairs
        mid1, mid2 = _middle(fp, lo1, hi1, bit), _middle(fp, lo2, hi2, bit)
        own = lo1 == lo2  # a node with itself: its halves, and one with the other once
        children = [(lo1, mid1, lo2, mid2, used), (mid1, hi1, mid2, hi2, used), (lo1, mid1, mid2, hi2, used + 1), tuple(x[~own] for x in (mid1, hi1, lo2, mid2, used + 1))]
        down = np.concatenate([np.stack(c) for c in children], axis=1)
        alive = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= k) & ~((down[0] == down[2]) & (down[1] - down[0] == 1))
        stack.append((bit - 1, down[:, alive]))


def _products(pairs: np.ndarray):
    """Batches (i, j) of all pairs of rows of node pairs that have no bits left: a node is rows of equal fingerprints."""
    lo1, hi1, lo2, hi2 = pairs[:4].astype(np.int64)
    width = hi2 - lo2
    size = (hi1 - lo1) * width
    ends = np.cumsum(size)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        x = np.arange(at, min(at + PAIRS, int(ends[-1])))
        p = np.searchsorted(ends, x, "right")
        off = x - (ends[p] - size[p])
        i, j = lo1[p] + off // width[p], lo2[p] + off % width[p]
        once = (lo1[p] != lo2[p]) | (i < j)
        yield i[once], j[once]


def _middle(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First row of each range whose ``bit`` is set: all ranges are halved side by side."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1) << np.uint64(bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        is_set = (fp[np.minimum(mid, len(fp) - 1)] & one) != 0
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)
    return lo


class Forest:
    """Union-find over rows; links are joined in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self._find(i), self._find(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(i, j), np.minimum(i, j))

    def _find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while (up := self.root[r]) is not None and (up != r).any():
            r = up
        self.root[x] = r
        return r

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, root) of each row that isn't its own root."""
        x = np.flatnonzero(self.root != np.arange(len(self.root)))
        return x, self._find(x)


def whole_buckets(batches, rows: int):
    """Tables of whole buckets, of about ``rows`` rows each. Batches come sorted by ``key``: a task holds what it works
    on, not all that it was dealt."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            other = batch.column("key").to_numpy() != held[-1].column("key")[-1].as_py()
            if other.any():
                cut = int(other.argmax())
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                batch, held, size = batch.slice(cut), [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _left(path: int, level: int, n: int) -> list[int]:
    """Bits outside the blocks that ``path`` names, one digit to base n for each level."""
    bits, digits = list(range(BITS - 1, -1, -1)), []
    for _ in range(level):
        path, digit = divmod(path, n)
        digits.append(digit)
    for d in reversed(digits):
        chosen = blocks(bits, n)[d]
        bits = [x for x in bits if x not in chosen]
    return bits


def _keyed(rows: DataFrame, level: int, n: int) -> DataFrame:
    """Each class under each of n blocks of the bits that its bucket's path left; the key tells path and bits."""

    def run(batches):
        for batch in batches:
            fp, path, key = (batch.column(c).to_numpy() for c in ("fp", "path", "key"))
            fp, key = fp.view(np.uint64), key.view(np.uint64)
            for p in np.unique(path).tolist():
                own = np.flatnonzero(path == p)
                for i, part in enumerate(blocks(_left(p, level, n), n)):
                    mixed = (key[own] * np.uint64(0x9E3779B97F4A7C15) + _gather(fp[own], part) + np.uint64(p * n + i + 1)) * np.uint64(0xD6E8FEB86659FD93)
                    mixed ^= mixed >> np.uint64(32)
                    taken = pa.array(own)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("fp").take(taken), pa.array(np.full(len(own), p * n + i, np.int64)), pa.array(mixed.view(np.int64))], ["id", "fp", "path", "key"])

    return rows.select("id", "fp", "path", "key").mapInArrow(run, "id long, fp long, path long, key long")


def links(classes: DataFrame, k: int = K, split: int = SPLIT) -> DataFrame:
    """(a, b): ids of linked classes, a spanning forest for each bucket. classes: (id, fp), one row per fp.

    A bucket of more than ``split`` classes goes down another level, to the blocks of the bits that are left; after
    LEVELS of them so few bits are left that no bucket can be large. Keys that happen to be equal join buckets, which
    costs comparisons and changes no link."""
    rows, dealt = classes.select("id", "fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key")), None
    for level in range(LEVELS + 1):
        here = materialize(_keyed(rows, level, k + 1), "blocks")
        add = lambda x: x.select("id", "fp", "key") if dealt is None else dealt.unionByName(x.select("id", "fp", "key"))  # noqa: B023, E731
        sizes = here.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if level == LEVELS or (most or 0) <= split:
            dealt = add(here)
            break
        placed = materialize(skew_safe_join(here, materialize(sizes, "block-sizes"), "key", "n", total), "placed-blocks")
        dealt, rows = add(placed.filter(F.col("n") <= split)), placed.filter(F.col("n") > split)

    def run(batches):
        for t in whole_buckets(batches, ROWS):
            ids, fp, key = (t[c].to_numpy() for c in ("id", "fp", "key"))
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, key))
            ids, fp, key = ids[order], fp[order], key[order]
            forest = Forest(len(fp))
            for i, j in trie_pairs(np.cumsum(np.r_[False, key[1:] != key[:-1]]), fp, k):
                forest.add(i, j)
            x, root = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[root])], ["a", "b"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _signatures(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, MINIMA minima of shingle hashes, BINS 8-bit minima by bin; 0: an empty bin), of different shingles.

    A repeated shingle counts once in all three: a fingerprint that counted repeats would follow a much repeated line, and
    put similar texts beyond the trie's budget."""
    from xxhash import xxh64_intdigest

    fp, keys, sig = np.zeros(len(texts), np.uint64), np.zeros((len(texts), MINIMA), np.uint64), np.zeros((len(texts), BINS), np.uint8)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
    for i, text in enumerate(texts):
        w = text.encode().lower().split()
        n = len(w) - words + 1
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if n > 0 else [b" ".join(w)] if w else []
        h = np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64))
        if not len(h):
            continue
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):
            count += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint16)
        fp[i] = np.packbits(count * 2 > len(h)).view(">u8")[0]
        keys[i] = [((h * x) ^ (h >> np.uint64(29))).min() for x in odd[:MINIMA]]
        bins, at = np.unique((h & np.uint64(BINS - 1)).astype(np.int64), return_index=True)
        sig[i, bins] = (h[at] >> np.uint64(24)) % np.uint64(255) + np.uint64(1)
    return fp, keys, sig


def _similar_links(classes: DataFrame, k: int, split: int) -> DataFrame:
    """(a, b) of classes (node, fp, keys, sig) that meet at a minimum, pass the trie's budget and the signature's estimate.

    Only classes that share a minimum with another carry their signature on. A bucket of more than ``split`` classes is
    cut into parts that meet two by two: every pair still meets, and no task holds more than two parts of a bucket."""
    minima = materialize(classes.select("node", F.posexplode("keys").alias("i", "v")).select("node", F.xxhash64("i", "v").alias("key")), "minima")
    sizes = materialize(minima.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "meetings")
    met = skew_safe_join(minima, sizes, "key", "n", minima.count())
    parts = F.ceil(F.col("n") / split).cast("int")
    cut = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: F.xxhash64("key", F.least(s, F.col("part")), F.greatest(s, F.col("part"))))
    dealt = cut.select("node", F.explode(meet).alias("key")).join(classes.select("node", "fp", "sig"), "node")

    def run(batches):
        for t in whole_buckets(batches, SIGNED_ROWS):
            node, fp, key = t["node"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["key"].to_numpy()
            order = np.lexsort((fp, key))
            bucket = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
            node, fp, sig = node[order], fp[order], np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, BINS)
            forest = Forest(len(fp))
            for i, j in trie_pairs(bucket, fp, k):
                for at in range(0, len(i), 4096):
                    p, q = i[at : at + 4096], j[at : at + 4096]
                    apart = forest._find(p) != forest._find(q)  # a pair already joined needs no comparison
                    p, q = p[apart], q[apart]
                    x, y = sig[order[p]], sig[order[q]]
                    either = ((x | y) != 0).sum(1)
                    near = ((x == y) & (x != 0)).sum(1) >= ESTIMATE * np.maximum(1, either)
                    forest.add(p[near], q[near])
            x, root = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[root])], ["a", "b"])

    return dealt.select("node", "fp", "sig", "key").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, k: int = SIMILAR_K, split: int = SPLIT) -> DataFrame:
    """As ``near_duplicates``, for a similarity of about 0.8 of five-word shingles, which lies 10 bits apart on average:
    too many for blocks of bits, so classes meet by minima of their shingles, and the trie works within those buckets.

    A class is the rows whose fingerprint, minima and signature are all equal, which the signature's estimate would link
    in any case; texts that share the fingerprint alone are compared like any other pair. (doc_id, same, component,
    component_id, n); n: rows of the class, component: a number of the group that no other group has."""

    def run(batches):
        for batch in batches:
            fp, keys, sig = _signatures(batch.column(1).to_pylist(), words)
            minima = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * MINIMA), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2), minima, pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "fp", "same", "keys", "sig"])

    t = text_of(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("__text"), F.xxhash64(t).alias("same"))
    rows = materialize(narrow.mapInArrow(run, "doc_id long, fp long, same long, keys array<long>, sig binary"), "signatures")
    rows = rows.withColumn("class", F.unhex(F.md5(F.concat("sig", F.concat_ws(",", F.col("keys").cast("array<string>"), F.col("fp").cast("string")).cast("binary")))))
    per = rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "keys", "sig")).alias("s"))
    # written once, so the numbers of the classes stay
    classes = materialize(per.select(F.monotonically_increasing_id().alias("node"), "class", "least", "n", "s.fp", "s.keys", "s.sig"), "classes")
    linked = components(_similar_links(classes.select("node", "fp", "keys", "sig"), k, split))
    return _named(rows.select("doc_id", "class", "same"), classes.select("class", "node", "least", "n"), linked, "class").drop("class")


def _named(rows: DataFrame, classes: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Rows with their component and its smallest id. classes: (key, node, least, n); components are of nodes."""
    placed = materialize(classes.join(linked, "node", "left").select(key, "least", "n", F.coalesce("component", "node").alias("component")), "placed")
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(placed.join(names, "component").select(key, "component", "component_id", "n"), "named")
    return skew_safe_join(rows, named, key, "n", rows.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """(doc_id, fp, same, component_id, n) for every row; n: rows with this fingerprint."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    # a class is named by its smallest id; one of null ids alone by a negative number that no other class has
    per = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(per.select("fp", "least", "n"), "classes")
    nodes = classes.select(F.col("fp").alias("id"), "fp")
    return _named(rows, classes.withColumn("node", F.col("fp")), components(links(nodes, k)), "fp").drop("component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of similar documents the row with the smallest id (of rows that share it, one), with all columns."""
    found = similar_documents(docs, id_col, text_col)
    low = -(1 << 63)
    # by the group itself, not its name: groups of null ids, or of a repeated id, share a name
    named = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = named.groupBy("component").agg(F.coalesce(F.min("doc_id"), F.lit(low)).alias("__key"), F.min("same").alias("__same")).select("__key", "__same")
    keyed = docs.withColumns({"__key": F.coalesce(F.col(id_col).cast("long"), F.lit(low)), "__same": F.xxhash64(text_of(text_col))})
    return keyed.join(kept, ["__key", "__same"], "left_semi").dropDuplicates(["__key", "__same"]).drop("__key", "__same")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
