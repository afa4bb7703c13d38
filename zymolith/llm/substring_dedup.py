"""Exact repeated-substring removal by recompression.

Texts are parsed into a hierarchy of symbols.  The first round names runs of
equal words; each later round names adjacent pairs: every symbol falls on the
left or the right side by a bit of its name, and a left symbol followed by a
right one becomes one symbol.  A name is a 64-bit hash of what it stands for,
so all executors give equal substrings the same names without exchanging a
dictionary.

A window of words is parsed alike wherever it occurs, but for symbols near its
two ends, which may merge with what stands outside.  ``_parse`` follows both
ends through the rounds: at each round the outermost symbol is given up if a
neighbour outside could take it.  What is left is the window's core.  If a
core symbol occurs once in the whole corpus, the window occurs once, and it is
ruled out; only windows whose core symbols all repeat (or whose core is empty)
are compared as whole windows.  This loses no repeated window.

Windows are compared by two independent hashes of 64 bits each, made from two
independent hashes of every word: among n remaining windows about n*n/2**129 pairs
of different ones are expected to agree, one in 10**10 corpora of 10**14 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packs import KEY_SCHEMA, cells_of, in_order, key_rows, map_packs, packed, repeated_elsewhere, with_found
from .text import U64, Words, hash_ranges, mix, pair, salted, words_of

WINDOW = 35
ROUNDS = 6
#: Seed of the second hash of words.
_SECOND = 0x5DEECE66D


def _window_starts(w: Words, window: int) -> np.ndarray:
    n = np.diff(w.first)
    room = np.maximum(n - window + 1, 0)
    ok = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(ok, w.first[:-1], 1)
    np.add.at(ok, w.first[:-1] + room, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def _window_hashes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows that start at ``at``, by doubling."""
    if not len(at):
        return np.zeros(0, U64)
    power, size, out, done = words, 1, None, 0
    left = window
    while left:
        if left & 1:
            part = power[at + done]
            out = mix(part) if out is None else pair(out, part)
            done += size
        left >>= 1
        if left:
            longer = power.copy()
            longer[: len(power) - size] = pair(power[: len(power) - size], power[size:])
            power, size = longer, size * 2
    return out


def _window_names(w: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window."""
    other = hash_ranges(w.data, w.start, w.end, _SECOND)
    return _window_hashes(w.hash, at, window), _window_hashes(other, at, window)


def _parse(w: Words, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, span in words, window starts, core begin, core end) at the last round."""
    n = len(w.hash)
    at = _window_starts(w, window)
    edge = np.zeros(n + 1, bool)  # a symbol may not cross a document's start
    edge[w.first] = True
    begins = edge[:n].copy()
    begins[1:] |= w.hash[1:] != w.hash[:-1]
    index = np.cumsum(begins) - 1
    start = np.flatnonzero(begins)
    span = np.diff(np.append(start, n))
    names = np.where(span > 1, pair(w.hash[start], span.astype(U64)), w.hash[start]) if n else w.hash
    head = edge[start] if n else begins
    lo, hi = index[at] + 1, index[at + window - 1]  # the outermost runs may go on outside
    for r in range(rounds):
        m = len(names)
        if m < 2:
            break
        right = (salted(names, 1000 + r) >> U64(63)).astype(bool)
        merges = ~right[:-1] & right[1:] & ~head[1:]  # symbol k with k+1
        keep = np.ones(m, bool)
        keep[1:] = ~merges
        padded = np.append(right, False)
        lo = lo + padded[lo]
        hi = np.where(hi > 0, hi - ~padded[np.maximum(hi - 1, 0)], hi)
        place = np.append(np.cumsum(keep) - 1, int(keep.sum()))
        lo, hi = place[np.minimum(lo, m)], place[np.maximum(hi, 0)]
        joined = np.flatnonzero(merges)
        names = names.copy()
        names[joined] = salted(pair(names[joined], names[joined + 1]), r)
        span = span.copy()
        span[joined] += span[joined + 1]
        names, span, head = names[keep], span[keep], head[keep]
    return names, span, at, lo, hi


def _possible(w: Words, found: np.ndarray | None, window: int, rounds: int) -> np.ndarray:
    """Starts of the windows that a unique core symbol does not rule out."""
    names, span, at, lo, hi = _parse(w, window, rounds)
    if not len(at):
        return at
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    unique = np.zeros(len(names), bool)
    unique[order] = alone
    unique &= span <= window
    if found is not None:
        unique[found] = False
    total = np.concatenate([[0], np.cumsum(unique)])
    return at[total[np.maximum(hi, lo)] - total[lo] == 0]


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word that lies in a window whose words also start elsewhere.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input
    and do not cross documents.  Returns (doc_id, n_words, n_removed, kept_text),
    one row an input row; kept words are joined by one space.

    Null or empty text: no words, empty ``kept_text``.  Texts shorter than the
    window keep all words.  Null or repeated ids are carried as they are; equal
    rows are each other's copies.  Other columns are ignored.  An empty table
    gives an empty result.
    """
    packs = packed(docs, "substring", id_col, text_col, in_buckets=True)

    def symbols(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        names, span, _, _, _ = _parse(words_of(rows.column(1)), window, rounds)
        inside = np.flatnonzero(span <= window)
        if len(inside):
            yield key_rows(pack, names[inside], inside)

    def windows(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        w = words_of(rows.column(1))
        at = _possible(w, None if found is None else found.to_numpy(zero_copy_only=False), window, rounds)
        if len(at):
            name, check = _window_names(w, at, window)
            yield key_rows(pack, name, at, check)

    def kept(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        w = words_of(rows.column(1))
        n = len(w.hash)
        at = _window_starts(w, window)
        name, check = _window_names(w, at, window)
        order, same = in_order(name, check)
        same = np.append(same, False)
        cover = np.zeros(n + 1, np.int64)
        twice = at[order[same[:-1] | same[1:]]]
        if found is not None:
            twice = np.concatenate([twice, found.to_numpy(zero_copy_only=False)])
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + window, -1)
        drop = np.cumsum(cover[:-1]) > 0
        count = np.concatenate([[0], np.cumsum(drop)])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(w.first)), pa.array(count[w.first[1:]] - count[w.first[:-1]]), joined_words(w, ~drop)],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )

    cells = cells_of(packs)
    names = repeated_elsewhere(map_packs(packs, symbols, KEY_SCHEMA), cells)
    again = repeated_elsewhere(map_packs(with_found(packs, names), windows, KEY_SCHEMA), cells)
    return map_packs(with_found(packs, again), kept, "doc_id long, n_words long, n_removed long, kept_text string")


def joined_words(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    n = len(w.data)
    start, end = w.start[keep], w.end[keep]
    step = np.zeros(n + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    out = np.cumsum(step[:-1], dtype=np.int8) > 0
    data = w.data.copy()
    closing = end[end < n]
    closing = closing[~np.isin(closing, w.doc)]  # a separator of the same document
    out[closing] = True
    data[closing] = 0x20
    offsets = np.searchsorted(np.flatnonzero(out), w.doc)
    data = data[out]
    # a separator after the last kept word is one byte too many
    full = offsets[1:] > offsets[:-1]
    trail = np.zeros(len(full), bool)
    trail[full] = data[offsets[1:][full] - 1] == 0x20
    if trail.any():
        live = np.ones(len(data), bool)
        live[offsets[1:][trail] - 1] = False
        data = data[live]
        offsets = offsets - np.concatenate([[0], np.cumsum(trail)])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
