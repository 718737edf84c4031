"""Packing by minimum bin slack.

A task packs what it reads, so nothing is shuffled. A document's ids are cut into whole windows and a rest. For each
next window the longest rest is laid down, and a subset-sum over a bitset (a Python integer) finds the multiset of
rest lengths that comes closest to the capacity left; its counts are read back from the bitsets kept on the way. What
is still free is filled by cutting one more rest. The last, partly filled window of a task is cut at powers of two.

Null and empty texts consist of the end id alone. Repeated rows are packed once each. A null id stays null. An empty
table gives no rows. The longest text, and POOL tokens besides, bound what a task holds.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, text_of
from .tokens import encoder, steps

TOKENIZER, END_ID, WINDOW = "word_bpe_49k.json", 2, 4096
#: Tokens gathered before rests are packed, and the number of rests that stay for the next round.
POOL, STAY = 1 << 20, 256
#: Distinct lengths that the first subset-sum looks at; if they don't fill the capacity, one over all lengths follows.
LENGTHS = 96


def closest(capacity: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The multiset of ``lengths`` (at most counts[n] of n) with the largest sum up to ``capacity``."""
    reach, mask, laid = 1, (1 << (capacity + 1)) - 1, []
    for n in lengths:
        left, k = min(counts[n], capacity // n), 1
        while left > 0:  # counts as 1, 2, 4, ...
            take = min(k, left)
            laid.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, k = left - take, 2 * k
        if reach >> capacity:
            break
    best, chosen = reach.bit_length() - 1, defaultdict(int)
    for n, take, before in reversed(laid):
        if not before >> best & 1:
            chosen[n] += take
            best -= n * take
    return dict(chosen)


class Packer:
    """Lays pieces (document, start, length) into sequences; documents are entries of ``ids``."""

    def __init__(self, window: int = WINDOW):
        self.window, self.rests, self.counts, self.next_id, self.placed = window, defaultdict(list), {}, 0, []

    def add(self, doc: int, length: int) -> None:
        whole = length - length % self.window
        for start in range(0, whole, self.window):
            self._lay([(doc, start, self.window)])
        if length > whole:
            self._rest((doc, whole, length - whole))

    def _rest(self, piece: tuple[int, int, int]) -> None:
        self.rests[piece[2]].append(piece)

    def _take(self, n: int) -> tuple[int, int, int]:
        piece = self.rests[n].pop()
        if not self.rests[n]:
            del self.rests[n]
        return piece

    def _lay(self, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for doc, start, n in pieces:
            self.placed.append((doc, start, n, self.next_id, offset))
            offset += n
        self.next_id += 1

    def pack(self, stay: int = 0) -> None:
        """Fill windows until ``stay`` rests are left; at 0 the last window is cut at powers of two."""
        left = sum(map(len, self.rests.values()))
        order = sorted(self.rests, reverse=True)
        while left > stay:
            order = [n for n in order if n in self.rests]
            pieces = [self._take(order[0])]
            free, left = self.window - pieces[0][2], left - 1
            counts = {n: len(self.rests[n]) for n in order if n in self.rests and n <= free}
            # the longest, and the shortest that can close a gap
            lengths = list(counts) if len(counts) <= LENGTHS else [*list(counts)[: LENGTHS // 2], *list(counts)[-LENGTHS // 2 :]]
            chosen = closest(free, counts, lengths)
            if len(lengths) < len(counts) and sum(n * k for n, k in chosen.items()) < free:
                chosen = closest(free, counts, list(counts))
            for n, k in chosen.items():
                pieces += [self._take(n) for _ in range(k)]
                free, left = free - n * k, left - k
            if free and self.rests:  # cut a longer rest: it is longer than the gap, or it would have fitted
                n = max(self.rests)
                if n > free:
                    doc, start, _ = self._take(n)
                    pieces.append((doc, start, free))
                    self._rest((doc, start + free, n - free))
                    order = sorted({*order, n - free}, reverse=True)
                    free = 0
            if free and not self.rests:
                self._powers(pieces)
            else:
                self._lay(pieces)

    def _powers(self, pieces: list[tuple[int, int, int]]) -> None:
        total, pieces = sum(p[2] for p in pieces), pieces[::-1]
        for bit in reversed(range(total.bit_length())):
            need, here = total & (1 << bit), []
            while need:
                doc, start, n = pieces.pop()
                here.append((doc, start, min(n, need)))
                if n > need:
                    pieces.append((doc, start + need, n - need))
                need -= min(n, need)
            if here:
                self._lay(here)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece. sequence_id: the task's number and, in its low 40 bits, the sequence's."""

    def run(batches):
        enc, packer, ids, names = encoder(tokenizer), Packer(window), {}, {}
        base, seen, pending = TaskContext.get().partitionId() << 40, 0, 0

        def placed():
            rows, packer.placed = packer.placed, []
            cols = list(zip(*rows)) if rows else [()] * 5
            crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, _, _ in rows]
            out = [pa.array([names[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(crc, pa.int64()), pa.array([len(ids[d]) for d in cols[0]], pa.int64()), pa.array([base + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())]
            kept = {p[0] for ps in packer.rests.values() for p in ps}
            for d in [d for d in ids if d not in kept]:
                del ids[d], names[d]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i, j in steps(texts):
                flat, counts = enc.encode(texts.slice(i, j - i))
                ends = np.cumsum(counts)
                for k, (key, n, end) in enumerate(zip(keys.slice(i, j - i).to_pylist(), counts.tolist(), ends.tolist())):
                    ids[seen + k], names[seen + k] = np.append(flat[end - n : end], np.uint32(end_id)).astype("<u4"), key
                    packer.add(seen + k, n + 1)
                    pending += n + 1
                seen += j - i
                if pending >= POOL:
                    packer.pack(STAY)
                    pending = 0
                    yield placed()
        packer.pack()
        yield placed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("__text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
