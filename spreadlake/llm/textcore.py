"""Vectorised text primitives that the Python stages of this package share.

Everything works on the UTF-8 bytes of an Arrow string column, a few MB at a time, so memory does
not depend on the batch size.  A *chunk* is a run of whole rows; one very long text is a chunk of
its own.  Words are ``[^\\x20\\x09-\\x0D]+``; because white space is ASCII, byte positions are safe
in any UTF-8 text.  Hashes of byte ranges are sums of the bytes times a pseudo-random weight of their
place in the range (a polynomial modulo 2**64 would give some long texts, such as the Thue-Morse
word and its complement, one hash).  Hashes of windows of words are polynomials of word hashes, cut
out of prefix sums, so a window hash costs the same for any window length; windows are short.  All
end with an avalanche step.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_WORD_BASE = 0xD6E8FEB86659FD93
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step: a bijection of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least)."""
    got = _tables.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _tables[base] = got = (out[0], out[1])
    return got


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end) for each pair; values are 64-bit."""
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


_WEIGHTS = mix(np.arange(1, (1 << 12) + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end) for each pair; the ranges ascend and don't overlap."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    inside = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    most = int(size.max(initial=0))
    weight = _WEIGHTS[place] if most <= len(_WEIGHTS) else mix((place + 1).astype(U) * U(0x9E3779B97F4A7C15)) | U(1)
    weight *= data[inside].astype(U) + U(1)
    sums = np.zeros(len(weight) + 1, U)
    np.cumsum(weight, out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + size.astype(U) * U(0xD6E8FEB86659FD93))


class Chunk:
    """Words of a few consecutive rows.

    data, offsets: bytes of the texts and where each begins; start, end: byte range of each word;
    first: index of each document's first word, with the number of words as last element.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, lower: bool = False) -> None:
        self.row, self.n = row, len(offsets) - 1
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n_words = np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every window of size words inside one document."""
        at = np.arange(max(0, len(words) - size + 1))
        at = at[at + size <= np.repeat(self.first[1:], self.n_words)[: len(at)]]
        return at, range_hashes(words, at, at + size, _WORD_BASE)

    def shingles(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash): its windows, or for fewer words the whole sequence as one."""
        at, hashes = self.windows(words, size)
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < size))
        few = range_hashes(words, self.first[short], self.first[short + 1], _WORD_BASE)
        docs = np.concatenate([self.doc_of_word()[at], short])
        hashes = np.concatenate([hashes, few])
        if len(short):
            order = np.argsort(docs, kind="stable")
            docs, hashes = docs[order], hashes[order]
        return docs, hashes


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, lower: bool = False, max_bytes: int = CHUNK_BYTES):
    """Chunks of a string column; row is the index of a chunk's first row."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, lower)
        lo = hi


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and how long they are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return at, np.diff(np.concatenate([at, [len(keys)]]))


def give_back() -> None:
    """Returns what this worker no longer uses to the system; workers live on between tasks, and so does what they keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
