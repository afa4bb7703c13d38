"""Benchmark decontamination in edit distance.

Texts and items are compared as sequences of words (lower-cased runs of letters
and digits).  A text holds an item if some run of its words is within
``floor(edit_share * words of the item)`` word edits of it.

1. Windows.  An item with k allowed edits is cut into k + 1 pieces; a run within
   k edits holds one of them unchanged.  Wherever a piece occurs in a text, a
   window of the item's size is laid so that the piece falls in its place.
2. CGK embedding.  A random walk reads a window: step j emits the word under the
   pointer, and a keyed bit of (j, word) says whether the pointer moves on.  Two
   sequences few edits apart soon walk in step again, so their edit distance
   becomes a Hamming distance.
3. Bit-sampling LSH.  Each table has its own walk and compares a few sampled
   steps; a window meets the items of its size that agree in some table.  Each
   size has its own number of tables: as many as items of that size need to meet
   themselves at the target recall, half of them with as many random edits as are
   allowed, half with as many substitutions at even distances.
4. Items met are verified by exact edit distance with free ends in the text.

The items are broadcast in blocks of at most ITEM_BYTES of text each; a larger
benchmark takes more passes over the documents, not more memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import empty_text
from .text import _GOLD, NOT_ALNUM, U64, blocks, mix, pair, words_of

EDIT_SHARE = 0.2
TARGET_RECALL = 0.99
#: Text of the items that are broadcast at once.
ITEM_BYTES = 16 << 20
#: Items of fewer words are held only by texts that consist of them.
LEAST_WORDS = 5
SAMPLED = 3
#: Items with random edits on which the tables of a size are counted.
PAIRS = 256
#: Tables that are walked at once, and cells of their walks.
_TABLES = 64
_CELLS = 1 << 23
_BLOCK = 1 << 20
_GATE = 20


def _words(texts: pa.Array):
    return words_of(pc.utf8_lower(texts.cast(pa.large_string())), NOT_ALNUM)


def cgk(words: np.ndarray, sizes: np.ndarray, tables: int, steps: int, skip: int = 0) -> np.ndarray:
    """Embeddings (tables, rows, steps): ``tables`` independent walks, from number ``skip`` on, over each row of ``words``.

    A row's words past its size are 0, and its walks end there.
    """
    n = len(words)
    padded = np.concatenate([words, np.zeros((n, 1), U64)], 1)
    at, rows = np.zeros((tables, n), np.int64), np.arange(n)[None, :]
    out = np.zeros((tables, n, steps), U64)
    golden = int(_GOLD)
    for j in range(steps):
        x = padded[rows, at]
        out[:, :, j] = x
        salt = np.array([(t * 4096 + j + 1) * golden % 2**64 for t in range(skip, skip + tables)], U64)[:, None]
        at = np.minimum(at + (mix(x + salt) >> U64(63)).astype(np.int64), sizes)
    return out


@lru_cache(4096)
def _sampled(size: int, part: int) -> np.ndarray:
    """The steps that each table of the ``part``-th _TABLES compares, (_TABLES, SAMPLED), in order."""
    rng = np.random.default_rng((size, part))
    return np.sort(rng.integers(0, 2 * size, (_TABLES, SAMPLED)), 1)


def table_keys(words: np.ndarray, sizes: np.ndarray, tables: int, skip: int = 0) -> np.ndarray:
    """Bit-sampling keys (rows, tables) of the tables from number ``skip`` on, a bounded number of walks at a time."""
    out = np.empty((len(words), tables), U64)
    rows = max(1, min(512, _CELLS // (_TABLES * 2 * max(1, int(sizes.max(initial=1))))))
    for a in range(0, len(words), rows):
        part, size = words[a : a + rows], sizes[a : a + rows]
        t = skip
        while t < skip + tables:
            block, inner = divmod(t, _TABLES)
            to = min(skip + tables, (block + 1) * _TABLES)
            at = np.stack([_sampled(int(k), block)[inner : inner + to - t] for k in size], 1)
            x = np.take_along_axis(cgk(part, size, to - t, int(at.max()) + 1, t), at, 2)
            h = x[:, :, 0]
            for k in range(1, SAMPLED):
                h = pair(h, x[:, :, k])
            out[a : a + rows, t - skip : to - skip] = h.T
            t = to
    return out


def tables_needed(items: np.ndarray, windows: np.ndarray, pair_of: np.ndarray, recall: float) -> int:
    """Tables in which all pairs have a row where ``items`` and ``windows`` meet, but for half of the share that may be missed.

    Only pairs that have not met yet walk on, so long items cost little more.
    """
    size, tables = items.shape[1], 0
    least = math.floor(len(np.unique(pair_of)) * (1 - recall) / 2)
    while len(np.unique(pair_of)) > least:
        more = max(8, tables // 2)
        sizes = np.full(len(items), size)
        met = (table_keys(items, sizes, more, tables) == table_keys(windows, sizes, more, tables)).any(1)
        left = ~np.isin(pair_of, pair_of[met])
        items, windows, pair_of, tables = items[left], windows[left], pair_of[left], tables + more
    return tables


def edit_distances(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least word edits between each row of ``items`` and a run of the same row of ``texts`` (0 matches nothing)."""
    n, size = items.shape
    width = texts.shape[1]
    above = np.zeros((width + 1, n), np.int32)
    for i in range(size):
        row = np.empty_like(above)
        row[0] = i + 1
        for j in range(width):
            row[j + 1] = np.minimum(np.minimum(above[j + 1], row[j]) + 1, above[j] + (items[:, i] != texts[:, j]))
        above = row
    return above.min(0)


@dataclass
class ItemIndex:
    """Everything about a block of items that the scan of documents needs."""

    ids: list
    words: list[np.ndarray]
    edits: list[int]
    tables: dict[int, int] = field(default_factory=dict)
    pieces: dict[int, tuple] = field(default_factory=dict)
    lsh: list[dict[tuple[int, int], list[int]]] = field(default_factory=list)
    whole: dict[bytes, list[int]] = field(default_factory=dict)


def _spoilt(rng: np.random.Generator, words: np.ndarray, edits: int) -> list:
    out = list(words)
    for _ in range(edits):
        k, what = int(rng.integers(len(out))), int(rng.integers(3))
        if what == 0:
            out.insert(k, U64(rng.integers(1, 2**63)))
        elif what == 1 and len(out) > 1:
            del out[k]
        else:
            out[k] = U64(rng.integers(1, 2**63))
    return out


def _spread(rng: np.random.Generator, words: np.ndarray, edits: int) -> list:
    """Substitutions at even distances: the edits that leave the shortest runs unchanged."""
    out = words.copy()
    out[np.unique(np.linspace(0, len(words) - 1, edits).round().astype(int)) if edits else []] = rng.integers(1, 2**63, edits, dtype=U64)
    return list(out)


def _edited(rng: np.random.Generator, words: np.ndarray, edits: int) -> np.ndarray:
    return np.array((_spoilt(rng, words, edits) + [U64(0)] * len(words))[: len(words)], U64)


def build_index(ids: list, texts: list[str], edit_share: float = EDIT_SHARE, recall: float = TARGET_RECALL) -> ItemIndex:
    w = _words(pa.array(texts, pa.large_string()))
    words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    index = ItemIndex(ids, words, [math.floor(edit_share * len(x)) for x in words])
    pieces: dict[int, dict[int, list]] = {}
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(words):
        if len(x) < LEAST_WORDS:
            if len(x):
                index.whole.setdefault(x.tobytes(), []).append(i)
            continue
        by_size.setdefault(len(x), []).append(i)
        q = len(x) // (index.edits[i] + 1)
        for j in range(index.edits[i] + 1):
            h = x[j * q]
            for k in range(1, q):
                h = pair(np.array([h]), x[j * q + k : j * q + k + 1])[0]
            pieces.setdefault(q, {}).setdefault(int(h), []).append((len(x), j * q))
    for q, by_hash in pieces.items():
        names = np.array(sorted(by_hash), U64)
        gate = np.zeros(1 << _GATE, bool)
        gate[names >> U64(64 - _GATE)] = True
        entries = [sorted(set(by_hash[int(h)])) for h in names]
        flat = np.array([e for x in entries for e in x], np.int64)
        index.pieces[q] = (gate, names, np.cumsum([0, *map(len, entries)]), flat[:, 0], flat[:, 1])
    if not by_size:
        return index
    for size, members in by_size.items():
        rng = np.random.default_rng(size)
        tries = [words[members[k % len(members)]] for k in range(PAIRS)]
        more = index.edits[members[0]]
        around = lambda: rng.integers(1, 2**63, more).tolist()
        texts = [np.array([*around(), *(_spread if k % 2 else _spoilt)(rng, x, more), *around()], U64) for k, x in enumerate(tries)]
        ends = np.cumsum([0, *map(len, texts)])
        text = np.concatenate(texts)
        at, start, own = _windows(index, text, ends)
        at, start = at[own == size], start[own == size]
        index.tables[size] = tables_needed(np.stack(tries)[at], _laid(text, start, ends[at + 1], size), at, recall)
        keys = table_keys(np.stack([words[i] for i in members]), np.full(len(members), size), index.tables[size])
        index.lsh += [{} for _ in range(index.tables[size] - len(index.lsh))]
        for row, i in zip(keys.tolist(), members, strict=True):
            for t, key in enumerate(row):
                index.lsh[t].setdefault((size, key), []).append(i)
    return index


def _windows(index: ItemIndex, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, size) of the windows that the pieces of items give."""
    out: list[np.ndarray] = []
    n, h = len(words), words
    for q in range(1, max(index.pieces, default=0) + 1):
        if q > 1:
            h = pair(h[: max(0, n - q + 1)], words[q - 1 :])
        if q not in index.pieces:
            continue
        gate, names, place, size, offset = index.pieces[q]
        at = np.flatnonzero(gate[h >> U64(64 - _GATE)])
        slot = np.minimum(np.searchsorted(names, h[at]), len(names) - 1)
        doc = np.searchsorted(first, at, "right") - 1
        hit = (names[slot] == h[at]) & (at + q <= first[doc + 1])
        at, slot, doc = at[hit], slot[hit], doc[hit]
        many = place[slot + 1] - place[slot]
        row = np.repeat(np.arange(len(at)), many)
        entry = np.repeat(place[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = np.maximum(first[doc[row]], np.minimum(at[row] - offset[entry], first[doc[row] + 1] - size[entry]))
        out.append(np.stack([doc[row], start, size[entry]], 1))
    rows = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _laid(words: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` words from ``start``; 0 where that is before 0 or past ``end``."""
    at = start[:, None] + np.arange(width)
    inside = (at >= 0) & (at < end[:, None])
    return np.where(inside, words[np.clip(at, 0, max(len(words) - 1, 0))], U64(0))


def find_items(index: ItemIndex, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, first word of the window) of the items that the texts hold."""
    w = _words(texts)
    words, first = w.hash, w.first
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if index.whole:
        for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < LEAST_WORDS)).tolist():
            for i in index.whole.get(words[first[d] : first[d + 1]].tobytes(), ()):
                best[d, i] = (0, 0)
    doc, start, size = _windows(index, words, first)
    if not len(doc):
        return [(d, i, 0, 0) for d, i in sorted(best)]
    width = int(size.max())
    laid = _laid(words, start, np.minimum(first[doc + 1], start + size), width)
    met = set()
    tables = np.array([index.tables[k] for k in size.tolist()])
    for n in np.unique(tables).tolist():
        same = np.flatnonzero(tables == n)
        own = size[same]
        for k, length, row in zip(same.tolist(), own.tolist(), table_keys(laid[same, : own.max()], own, n).tolist(), strict=True):
            for t, key in enumerate(row):
                met.update((k, i) for i in index.lsh[t].get((length, key), ()))
    if not met:
        return [(d, i, 0, 0) for d, i in sorted(best)]
    ks, items = np.array(sorted(met)).T
    for length in np.unique(size[ks]).tolist():
        mine = size[ks] == length
        k, i = ks[mine], items[mine]
        more = index.edits[int(i[0])]
        own = np.stack([index.words[x] for x in i.tolist()])
        edits = np.zeros(len(k), np.int64)
        rest = np.flatnonzero((laid[k, :length] != own).any(1))
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            d = doc[k[part]]
            begin = np.maximum(start[k[part]] - more, first[d])
            edits[part] = edit_distances(own[part], _laid(words, begin, np.minimum(first[d + 1], begin + length + 2 * more), length + 2 * more))
        for kk, ii, e in zip(k.tolist(), i.tolist(), edits.tolist(), strict=True):
            if e <= index.edits[ii]:
                key = (int(doc[kk]), ii)
                found = (e, int(start[kk] - first[doc[kk]]))
                best[key] = min(best.get(key, found), found)
    return [(d, i, e, s) for (d, i), (e, s) in sorted(best.items())]


def _item_blocks(items: DataFrame, edit_share: float, recall: float, item_id: str, item_text: str) -> Iterator[ItemIndex]:
    rows = items.select(F.col(item_id).cast("long").alias("id"), empty_text(item_text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / ITEM_BYTES)) if total > ITEM_BYTES else 1
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
        part.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))
        yield build_index([r["id"] for r in part], [r["text"] for r in part], edit_share, recall)


def find_contamination(docs: DataFrame, items: DataFrame, edit_share: float = EDIT_SHARE, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, at_word): a row for each row of ``docs`` and item that it holds.

    ``edits``: the least found; ``at_word``: first word of that window.  Null or
    empty texts and items hold nothing and are in nothing.  Items under five words
    count only where they are a whole text.  Null or repeated ids are carried as
    they are; repeated items are reported each.  Other columns are ignored; an
    empty table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text"))
    out = None
    for index in _item_blocks(items, edit_share, recall, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                ids, texts = batch.columns
                for a, b in blocks(texts, _BLOCK):
                    found = find_items(index, texts.slice(a, b - a))
                    if found:
                        d, i, e, s = (list(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([a + x for x in d])), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(e, pa.int64()), pa.array([len(index.words[x]) for x in i], pa.int64()), pa.array(s, pa.int64())],
                            ["doc_id", "item_id", "edits", "item_words", "at_word"],
                        )

        part = rows.mapInArrow(run, "doc_id long, item_id long, edits long, item_words long, at_word long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Null or empty texts hold nothing and stay; rows with null or repeated ids are
    judged each by its text; an empty table on either side changes nothing.
    """
    at = docs.columns.index(text_col)
    for index in _item_blocks(items, more.get("edit_share", EDIT_SHARE), more.get("recall", TARGET_RECALL), more.get("item_id", "item_id"), more.get("item_text", "text")):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
                keep = np.ones(batch.num_rows, bool)
                for a, b in blocks(texts, _BLOCK):
                    keep[[a + d for d, *_ in find_items(sent.value, texts.slice(a, b - a))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
