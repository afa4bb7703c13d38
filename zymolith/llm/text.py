"""Vectorised word tables over Arrow string columns.

Words are maximal runs of bytes outside ``{0x20, 0x09..0x0D}``.  All of these
separators are ASCII, so byte runs and code-point runs are the same words.
Every function works on whole texts; nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)

#: Odd multipliers of the 64-bit mixer (splitmix64, public domain).
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """An independent 64-bit hash of 64-bit values for each salt."""
    return mix(x + U64(((salt + 1) * int(_GOLD)) % 2**64))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two 64-bit values."""
    return mix(mix(a) * _GOLD + b)


#: Separators of letters and digits: every other ASCII byte.
NOT_ALNUM = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])


@dataclass
class Words:
    """Words of a block of documents.

    ``data``: the documents' bytes; ``doc``: byte offset of each document (one
    more than documents); ``start``/``end``: byte range of each word;
    ``first``: index of each document's first word (one more than documents);
    ``hash``: 64-bit hash of each word's bytes.
    """

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.doc) - 1

    def owner(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(self.n_docs, dtype=np.int64), np.diff(self.first))


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a round over the ranges that are that long; independent for each seed."""
    out = mix((end - start).astype(U64) * _GOLD + U64(seed))
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    left = end - start
    out = mix(out ^ (eight[start] & _MASKS[np.minimum(left, 8)]))
    live = np.flatnonzero(left > 8)
    k = 8
    while len(live):
        at = start[live] + k
        out[live] = mix(out[live] * _M1 + (eight[at] & _MASKS[np.minimum(end[live] - at, 8)]))
        k += 8
        live = live[left[live] > k]
    return out


def words_of(texts: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """Splits a block of texts into words; ``between`` marks the bytes that separate words."""
    data, doc = string_bytes(texts)
    n = len(data)
    solid = ~between[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = doc[1:-1][doc[1:-1] < n]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = inner[inner > 0] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, doc, start, end, np.searchsorted(start, doc), hash_ranges(data, start, end))


def blocks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` of text each (one row at least)."""
    n, at = len(texts), 0
    if not n:
        return
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    while at < n:
        to = int(np.searchsorted(size, size[at] + most_bytes, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word grams that lie in one document: (positions, hashes)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    ok = np.ones(n, bool)
    for e in range(1, k):  # the last k-1 words of each document start no gram
        at = first[1:] - e
        ok[at[at >= first[:-1]]] = False
    at = np.flatnonzero(ok)
    at = at[at + k <= n]
    h = words[at]
    for j in range(1, k):
        h = pair(h, words[at + j])
    return at, h
