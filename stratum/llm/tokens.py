"""Fast encoding of whole texts with the ``tokenizers`` library.

Both public BPE files split a text before a single space that stands between two characters that aren't white space,
before a punctuation mark after a letter or digit, and around a single line end: no pre-token crosses such a place.
So a text is cut there, the distinct pieces of a batch are encoded by the library once, many in one call, and ids
are put together by numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beside a space: such texts are cut by the slower expression below.
_ODD = r"^ | $|[\s\pZ\x{85}\x{0b}\x{1c}-\x{1f}] | [\s\pZ\x{85}\x{0b}\x{1c}-\x{1f}]"
_SPACE = r"[\s\x85\x0b\x1c-\x1f]"
_CUT = re.compile(rf"(?<!{_SPACE}) (?!{_SPACE})")
SEPARATOR = "<|endoftext|>"
#: Pieces kept between batches by a worker; more are encoded again in each batch.
KEPT_PIECES = 500_000
#: A longer piece (characters) isn't kept.
KEPT_LENGTH = 64
#: Bytes of text handled at once.
STEP_BYTES = 8 << 20


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


#: One that occurs in no text of a batch stands at the cuts.
_MARKS = ("\x01", "\x02", "\x03", "\x04", "\ue000", "\uf8ff")


def pieces(texts: pa.Array, keep_space: bool) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts and, by text, the number of pieces. keep_space: a piece after a cut starts with the space."""
    mark = next((m for m in _MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
    if mark is None:
        return texts, np.ones(len(texts), np.int64)
    space = " " if keep_space else ""
    odd = pc.match_substring_regex(texts, _ODD)
    marked = pc.replace_substring(texts, " ", mark + space)
    marked = pc.replace_substring_regex(marked, r"([\pL\pN])([.,;:!?])", rf"\1{mark}\2")
    marked = pc.replace_substring_regex(marked, rf"([^\s{mark}])\n([^\s{mark}])", f"\\1{mark}\n{mark}\\2")
    if (n := pc.sum(odd).as_py() or 0) > 0:
        cut = [(mark + space).join(_CUT.split(t)) for t in texts.filter(odd).to_pylist()]
        marked = pc.replace_with_mask(marked, odd, pa.array(cut, marked.type)) if n < len(texts) else pa.array(cut, marked.type)
    parts = pc.split_pattern(marked, mark)
    return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)


def steps(texts: pa.Array, at_once: int = STEP_BYTES):
    """Slices (from, to) of about ``at_once`` bytes; a longer text stands alone."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > at_once:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(texts):
        yield start, len(texts)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... of lengths[i] each, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class PieceEncoder:
    """Base of cached encoders: ids of a text are the ids of its pieces, one after another."""

    def __init__(self, keep_space: bool):
        self.keep_space = keep_space
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 12, np.int64)

    def encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all of ``new``, flat, and the number of each."""
        raise NotImplementedError

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, length) of each word."""
        at = np.fromiter(map(self.known.get, words, _minus_one()), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        n = len(self.known)
        if not len(missing):
            return self.flat, self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        new = [words[i] for i in missing]
        ids, lengths = self.encode_pieces(new)
        base = int(self.offsets[n])
        keep = max(0, KEPT_PIECES - n)
        if keep and all(len(w) <= KEPT_LENGTH for w in new):
            kept = min(keep, len(new))
        else:
            kept = 0
        if kept:
            ends = np.cumsum(lengths[:kept])
            self.flat = _grown(self.flat, base + int(ends[-1]))
            self.flat[base : base + ends[-1]] = ids[: ends[-1]]
            self.offsets = _grown(self.offsets, n + kept + 1)
            self.offsets[n + 1 : n + kept + 1] = base + ends
            self.known.update(zip(new[:kept], range(n, n + kept)))
        old = at >= 0
        start, length = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[old], length[old] = self.offsets[at[old]], self.offsets[at[old] + 1] - self.offsets[at[old]]
        flat = np.concatenate([self.flat[: self.offsets[n]], ids])
        start[missing], length[missing] = self.offsets[n] + np.cumsum(lengths) - lengths, lengths
        return flat, start, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        flat, start, length, codes, counts = self._coded(texts)
        n = length[codes]
        return flat[spread(start[codes], n)], _sums(n, counts)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        _, _, length, codes, counts = self._coded(texts)
        return _sums(length[codes], counts)

    def _coded(self, texts: pa.Array):
        flat, counts = pieces(texts, self.keep_space)
        coded = flat.dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
        return (*self._look_up(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)


def _minus_one():
    while True:
        yield -1


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class LibraryEncoder(PieceEncoder):
    """``tokenizers`` with add_special_tokens=False, unused truncation and padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        # a byte-level tokenizer keeps the space before a word; one that drops white space doesn't need it
        super().__init__(keep_space=bool(self.tokenizer.encode(" ", add_special_tokens=False).ids))

        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values(), default=0) + 1
        #: ids that begin a piece which starts with a space, or end a piece of letters alone
        self.begins, self.ends_word = np.zeros(size, bool), np.zeros(size, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _one_call(self, part: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and lengths of pieces that can be told apart by their ids when encoded together."""
        if self.keep_space:  # each starts with its only space
            ids = self._ids("".join(part))
            first = np.flatnonzero(self.begins[ids])
            lengths = np.diff(first, append=len(ids))
        else:  # each is one word
            ids = self._ids(" ".join(part))
            lengths = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        return (ids, lengths) if len(lengths) == len(part) and lengths.sum() == len(ids) else None

    def _separated(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.separator is not None and not any("<|" in w or "|>" in w for w in part):
            ids = self._ids(SEPARATOR.join(part))
            cuts = np.flatnonzero(ids == self.separator)
            return ids[ids != self.separator], np.diff(np.append(cuts, len(ids)), prepend=-1) - 1
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in part]
        return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _plain(self, w: str) -> bool:
        if self.keep_space:
            return w[:1] == " " and w.count(" ") == 1 and not w[-1].isspace() and "<" not in w
        return w.isalpha() and "\u0130" not in w  # its lower case holds a mark that is no letter

    def encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter(map(self._plain, new), bool, len(new))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n, ids, lengths = int(plain.sum()), [], []
        for low, high, call in ((0, n, self._one_call), (n, len(new), self._separated)):
            for i in range(low, high, 2000):
                part = [new[k] for k in order[i : min(high, i + 2000)]]
                x = call(part) or self._separated(part)
                ids.append(x[0])
                lengths.append(x[1])
        if not ids:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        flat, size = np.concatenate(ids), np.concatenate(lengths)
        start = np.empty(len(new), np.int64)
        start[order] = np.cumsum(size) - size
        out = np.empty(len(new), np.int64)
        out[order] = size
        return flat[spread(start, out)], out


_ENCODERS: dict = {}


def encoder(path: str, kind=LibraryEncoder) -> PieceEncoder:
    """The worker's encoder of this file, kept between tasks."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]
