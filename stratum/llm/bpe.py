"""BPE encoding and decoding without the library: contiguous rank arrays for short words.

A word's parts stand in one list and the ranks of adjacent parts in another. The lowest rank is found by scanning,
its boundary is deleted and the ranks on either side are refreshed. A long word takes a heap and a linked list
instead, since scanning is quadratic. Both give the same ids: the leftmost pair of the lowest rank merges first.

Null and empty texts have no ids. Repeated rows are encoded once each. A null id stays null. An empty table gives no
rows. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, text_of
from .tokens import PieceEncoder, encoder, steps, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: The pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a word is scanned.
SHORT = 96
NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class RankArrayBpe(PieceEncoder):
    def __init__(self, path: str):
        super().__init__(keep_space=True)
        with open(tokenizer_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.byte_id = regex.compile(PATTERN), [vocab[letters[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        of = {letter: b for b, letter in letters.items()}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    def scan(self, word: bytes) -> list[int]:
        parts, get, merged = [self.byte_id[b] for b in word], self.rank.get, self.merged
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], NONE)
        return parts

    def heap(self, word: bytes) -> list[int]:
        parts, get, n = [self.byte_id[b] for b in word], self.rank.get, len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(queue, (q, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        return self.scan(raw) if len(raw) <= SHORT else self.heap(raw)

    def piece(self, text: str) -> list[int]:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.word(text)
        out: list[int] = []
        for part in self.split.split(text) if self.split and "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self.words.findall(part):
                    out += self.word(w)
        return out

    def encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.piece(w) for w in new]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batches):
        enc = encoder(tokenizer, RankArrayBpe)
        for batch in batches:
            for i, j in steps(batch.column(1)):
                flat, counts = enc.encode(batch.column(1).slice(i, j - i))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("__text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches):
        enc = encoder(tokenizer, RankArrayBpe)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass."""

    def run(batches):
        enc = encoder(tokenizer, RankArrayBpe)
        for batch in batches:
            texts = batch.column(1)
            for i, j in steps(texts):
                flat, counts = enc.encode(texts.slice(i, j - i))
                flat, ends = flat.astype("<u4"), np.cumsum(counts).tolist()
                ids, text = [], []
                for n, end in zip(counts.tolist(), ends):
                    own = flat[end - n : end]
                    ids.append(hashlib.sha256(own.tobytes()).hexdigest())
                    text.append(hashlib.sha256(enc.decode(own.tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("__text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
