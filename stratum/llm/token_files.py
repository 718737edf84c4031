"""Token files: ids in canonical, length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

The ids of all documents are counted first; package-merge gives the code lengths, and canonical codes follow from
them alone. A document's codes start at a byte. A block holds whole documents in ascending id order, the payload, and
the bit offset of every STRIDE-th id of each document: a reader decodes all stretches between them side by side, by
one look into a table of 2**MAX_BITS entries for each id.

Format: a folder of Parquet files. ``codebook``: one row, a byte per id with its code length (0: not used).
``blocks``: part, start (ids of the part before the block), doc_ids, doc_tokens, payload, checkpoints (little-endian
unsigned 64-bit bit offsets). Parts follow each other by doc_id.

Null and empty texts consist of the end id. Repeated ids are kept, in any order among themselves; null ids come
first. An empty table gives no blocks and reads back as no rows. A block holds BLOCK_IDS ids, or one longer document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fresh_path, materialize, text_of
from .tokens import encoder, spread, steps, tokenizer_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
MAX_BITS, STRIDE, BLOCK_IDS = 17, 512, 1 << 20
#: Longest code that an id may need: as many bits as a window of four bytes shows from any bit of its first.
WIDEST = 25
#: Ids to a part: what one task sorts and writes. Bounds of so many parts are sought at once; of more, within those.
PART_IDS, AT_ONCE = 8 << 20, 10_000


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0. More ids than ``limit``
    bits can tell apart raise it to what they need."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    if limit > WIDEST:
        raise ValueError(f"{len(used)} ids need codes of {limit} bits, over {WIDEST}")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    rows, level = [], np.empty(0, np.int64)
    for _ in range(limit):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        at = np.argsort(both, kind="stable")
        rows.append(at < len(leaf))
        level = both[at]
    lengths, take = np.zeros(len(leaf), np.int64), 2 * len(leaf) - 2
    for is_leaf in reversed(rows):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(code of each id, table from the next bits to id << 5 | length, bits that the table looks at)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    bits = max(1, int(lengths.max(initial=1)))
    size = (1 << (bits - lengths[order].astype(np.int64))).astype(np.int64)
    first = np.cumsum(size) - size
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = first >> (bits - lengths[order].astype(np.int64))
    table = np.zeros(1 << bits, np.uint32)
    table[: int(size.sum())] = np.repeat((order.astype(np.uint32) << 5) | lengths[order], size)
    return codes, table, bits


def _window(bits: int) -> int:
    """Bytes that show a code of ``bits`` bits from any bit of the first."""
    return 3 if bits <= 17 else 4


def encode_docs(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(payload, its byte offsets by document, bit position of each id within its document)."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    total = np.concatenate([[0], ends])
    doc_end = np.cumsum(counts)
    bits = total[doc_end] - total[doc_end - counts]
    offsets = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    within = ends - width - np.repeat(total[doc_end - counts], counts)
    at = within + np.repeat(offsets[:-1] * 8, counts)
    span = _window(int(lengths.max(initial=1)))
    value = codes[ids].astype(np.int64) << (8 * span - width - (at & 7))
    byte, n = at >> 3, int(offsets[-1])
    out = np.zeros(n + span - 1)
    for k in range(span):
        out[k:] += np.bincount(byte, weights=(value >> 8 * (span - 1 - k)) & 255, minlength=n + span - 1)[: n + span - 1 - k]
    return out[:n].astype(np.uint8), offsets, within


def decode_block(payload: bytes, checkpoints: np.ndarray, lane_ids: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Ids of a block. lane_ids: ids of each stretch that starts at a checkpoint; all advance by an id at a time."""
    span = _window(bits)
    raw = np.frombuffer(payload + b"\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:] if span == 3 else (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.empty(int(lane_ids.sum()), np.uint32)
    order = np.argsort(-lane_ids, kind="stable")
    at, to = checkpoints[order].astype(np.int64), (np.cumsum(lane_ids) - lane_ids)[order]
    running = np.searchsorted(-lane_ids[order], -np.arange(int(lane_ids.max(initial=0))), side="left")
    mask = (1 << bits) - 1
    for n in running.tolist():
        p = at[:n]
        found = table[(window[p >> 3] >> (8 * span - bits - (p & 7)).astype(np.uint32)) & mask]
        out[to[:n]] = found >> 5
        p += found & 31
        to[:n] += 1
    return out


def _lanes(tokens: np.ndarray) -> np.ndarray:
    """Ids of each stretch of documents of so many ids."""
    n = -(-tokens // STRIDE)
    out = np.full(int(n.sum()), STRIDE, np.int64)
    last = np.cumsum(n)[tokens > 0] - 1
    out[last] = (tokens - (n - 1) * STRIDE)[tokens > 0]
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids binary): 16-bit ids where the vocabulary allows, else 32-bit."""
    wide = _vocabulary(tokenizer) > 1 << 16

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for i, j in steps(texts):
                flat, counts = enc.encode(texts.slice(i, j - i))
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id).astype("<u4" if wide else "<u2")
                counts = counts + 1
                offsets = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
                ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), ids], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("__text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size()


def _flat(column: pa.Array, wide: bool) -> np.ndarray:
    """All ids of a binary column that has no nulls."""
    if not len(column):
        return np.empty(0, np.uint32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4" if wide else "<u2").astype(np.uint32)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Write the files of ``docs`` to ``path``, a folder that all executors share."""
    vocabulary = max(_vocabulary(tokenizer), end_id + 1)
    wide = vocabulary > 1 << 16
    tokens = materialize(encode(docs, id_col, text_col, tokenizer, end_id), "tokens")

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), wide), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id of the vocabulary at most
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    codes, _, _ = canonical(lengths)

    bounds = _bounds(tokens, max(1, -(-int(counts.sum()) // PART_IDS)))

    def compress(batches):
        for batch in batches:
            for i, j in steps(batch.column(2), 1 << 20):
                part = batch.slice(i, j - i)
                n = part.column(1).to_numpy().astype(np.int64)
                payload, offsets, within = encode_docs(_flat(part.column(2), wide), n, codes, lengths)
                lanes = -(-n // STRIDE)
                marks = within[spread(np.cumsum(n) - n, n)][_every(n)].astype("<u8")
                mark_at = np.concatenate([[0], np.cumsum(lanes)]) * 8
                binary = lambda at, data: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                keys = part.column(0).cast(pa.int64())
                number = np.searchsorted(bounds, keys.fill_null(-(1 << 63)).to_numpy(), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), keys, part.column(1), binary(offsets, payload), binary(mark_at, marks)], ["part", "doc_id", "n_tokens", "payload", "marks"])

    def block(batches):
        part, start, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made():
            table = pa.Table.from_batches(held)
            n, base, marks = table["n_tokens"].to_pylist(), 0, []
            for p, m in zip(table["payload"].to_pylist(), table["marks"].to_pylist()):
                marks.append(np.frombuffer(m, "<u8") + np.uint64(8 * base))
                base += len(p)
            row = [[part], [start], [table["doc_id"].to_pylist()], [n], [b"".join(table["payload"].to_pylist())], [np.concatenate(marks).astype("<u8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _BLOCK_TYPES)], _BLOCK_NAMES), sum(n)

        for batch in batches:
            n = batch.column(1).to_numpy()
            at = 0
            for i, k in enumerate(n.tolist()):
                size += k
                if size >= BLOCK_IDS:
                    held.append(batch.slice(at, i + 1 - at))
                    out, total = made()
                    yield out
                    start, held, size, at = start + total, [], 0, i + 1
            if at < len(n):
                held.append(batch.slice(at))
        if held:
            yield made()[0]

    packed = tokens.mapInArrow(compress, "part int, doc_id long, n_tokens long, payload binary, marks binary")
    ordered = packed.repartitionById(len(bounds) + 1, F.col("part")).drop("part").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(block, _BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")


def _bounds(tokens: DataFrame, parts: int) -> np.ndarray:
    """Upper ends of all but the last of ``parts`` parts with about as many documents each, from the ids alone: eight
    bytes for PART_IDS ids reach the driver and the tasks. Of more than AT_ONCE, first so many are found, and then those
    within each of them, side by side."""
    wanted = lambda n: [i / n for i in range(1, n)]
    first = min(parts, AT_ONCE)
    if first < 2:
        return np.empty(0, np.int64)
    coarse = np.unique(np.array(tokens.agg(F.percentile_approx("doc_id", wanted(first), 20 * first)).first()[0] or [], np.int64))
    each = -(-parts // first)
    if each < 2:
        return coarse

    def number(batches):
        for batch in batches:
            keys = batch.column(0).drop_null()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(coarse, keys.to_numpy(), side="left")), keys], ["part", "doc_id"])

    within = tokens.select("doc_id").mapInArrow(number, "part long, doc_id long").groupBy("part").agg(F.percentile_approx("doc_id", wanted(each), 20 * each).alias("b"))
    fine = within.select(F.explode("b").alias("b")).toArrow().column("b").to_numpy()
    return np.unique(np.concatenate([coarse, fine]))


def _every(n: np.ndarray) -> np.ndarray:
    """Flat positions of every STRIDE-th id of documents of n ids."""
    lanes = -(-n // STRIDE)
    doc = np.repeat(np.cumsum(n) - n, lanes)
    return doc + (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRIDE


_BLOCK_NAMES = ["part", "start", "doc_ids", "doc_tokens", "payload", "checkpoints"]
_BLOCK_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
_BLOCK_DDL = "part int, start long, doc_ids array<long>, doc_tokens array<long>, payload binary, checkpoints binary"


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>), or with ``digest`` ids_crc32 for ids, decoded from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)
    _, table, bits = canonical(lengths)
    # a row per part, of which each has PART_IDS ids: where the part starts
    totals = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(doc_tokens, 0L, (a, x) -> a + x)")).alias("n")).orderBy("part").toArrow()
    number, n = totals.column("part").to_numpy(), totals.column("n").to_numpy()
    starts = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    starts[number] = np.cumsum(n) - n

    def run(batches):
        for batch in batches:
            for part, start, docs, n, payload, marks in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.array(n, np.int64)
                ids = decode_block(payload, np.frombuffer(marks, "<u8"), _lanes(n), table, bits).astype("<u4")
                ends = np.cumsum(n)
                first = int(starts[part]) + start + ends - n
                if digest:
                    last = pa.array([zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.select(*_BLOCK_NAMES).mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write(documents(spark, sf_dir), path)
    return read(spark, path, digest=True)
