"""Removal of lines whose log template recurs across documents.

A line's tokens are its words; a token with a digit is a variable field.  The
template tree has a fixed depth: token count, then the leading tokens.  At a
leaf, a position keeps its token if that token stands there in enough
documents, and becomes a variable field if not.  A template with enough fixed
tokens that enough documents share is boilerplate, and its lines are dropped.

All three decisions (leaf, token at a position of a leaf, template) are counts
of documents for 64-bit keys, so nothing depends on the order of the lines and
no leaf is ever collected: a leaf that holds a third of all lines is, to every
pack of documents, one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.scratch import bucketed
from .packs import COUNT_SCHEMA, cells_of, document_counts, in_many_documents, map_packs, packed, with_found
from .shared import written
from .text import U64, pair, salted, words_of

#: Leading tokens on the path of the tree.
DEPTH = 3
#: Documents that make a leaf, a token or a template recurrent.
LEAST_DOCUMENTS = 4
#: Share of a template's tokens that must be fixed.
FIXED_SHARE = 0.6
_FIELD = U64(0x5F5F4649454C445F)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _lines(texts: pa.Array, fixed_share: float):
    """(tokens, first token of each line, whether it has too many fields for a template, document of each line, place of each line in its document)."""
    w = words_of(texts)
    breaks = np.flatnonzero(w.data == 0x0A)
    starts = np.union1d(w.doc[:-1], breaks + 1) if w.n_docs else np.zeros(0, np.int64)
    starts = starts[starts < len(w.data)]
    doc = np.searchsorted(w.doc, starts, "right") - 1
    # a line break that ends a document starts no line of the next one: that line starts there anyway
    place = np.searchsorted(breaks, starts, "left") - np.searchsorted(breaks, w.doc[doc], "left")
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w.data])])
    field = digits[w.end] > digits[w.start]
    first = np.append(np.searchsorted(w.start, starts), len(w.start))
    n = np.diff(first)
    fields = np.concatenate([[0], np.cumsum(field)])
    heavy = n - (fields[first[1:]] - fields[first[:-1]]) < fixed_share * n
    tokens = np.where(field & ~np.repeat(heavy, n), _FIELD, w.hash[first[0] : first[-1]]) if len(starts) else w.hash
    return tokens, first, heavy, doc, place


def _leaves(tokens: np.ndarray, first: np.ndarray, heavy: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines with tokens, their leaf keys)."""
    n = np.diff(first)
    lines = np.flatnonzero(n > 0)
    key = salted(n[lines].astype(U64), 41)
    for k in range(depth):
        longer = n[lines] > k
        key[longer] = pair(key[longer], tokens[first[lines[longer]] + k])
    alone = np.flatnonzero(heavy[lines])
    row, place, at = _rows(lines[alone], first)
    whole = np.zeros(len(alone), U64)
    np.add.at(whole, row, salted(pair(tokens[at], place.astype(U64)), 43))
    key[alone] = pair(key[alone], whole)
    return lines, key


def _rows(lines: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the given lines: (row among them, position in the line, index of the token)."""
    n = first[lines + 1] - first[lines]
    row = np.repeat(np.arange(len(lines)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, place, np.repeat(first[lines], n) + place


def drop_template_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, depth: int = DEPTH, fixed_share: float = FIXED_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), one row per row of ``docs``.

    Lines are what line feeds separate; kept ones are joined by line feeds.
    Lines without tokens are kept; lines of fewer than ``depth`` tokens, and lines
    whose share of tokens without digits is below ``fixed_share``, go where ``least``
    documents have them word for word.  Null or empty text: no lines.
    Null or repeated ids are carried as they are; every row counts as a document.
    Other columns are ignored; an empty table gives an empty result.
    """
    packs = packed(docs, "lines", id_col, text_col, in_buckets=True)

    cells = cells_of(packs)

    def often(table: DataFrame, keys: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return in_many_documents(keys(table), cells, least)

    def leaves(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        tokens, first, heavy, doc, _ = _lines(rows.column(1), fixed_share)
        lines, key = _leaves(tokens, first, heavy, depth)
        if len(lines):
            yield document_counts(pack, key, doc[lines])[0]

    def candidates(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        """The lines of recurrent leaves, without their texts."""
        if found is None:
            return
        tokens, first, heavy, doc, place = _lines(rows.column(1), fixed_share)
        lines, key = _leaves(tokens, first, heavy, depth)
        names, slot = np.unique(key, return_inverse=True)
        live = np.zeros(len(names), bool)
        live[found.to_numpy(zero_copy_only=False)] = True
        live = live[slot]
        lines, key = lines[live], key[live]
        _, _, at = _rows(lines, first)
        n = np.concatenate([[0], np.cumsum(first[lines + 1] - first[lines])])
        yield pa.RecordBatch.from_arrays(
            [pa.array([pack]), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (doc[lines], place[lines], n)), *(pa.array([x.tobytes()], pa.binary()) for x in (key, tokens[at]))],
            ["pack", "doc", "place", "first", "leaf", "tokens"],
        )

    leaf = often(packs, lambda some: map_packs(some, leaves, COUNT_SCHEMA))
    lines = map_packs(with_found(packs, leaf), candidates, "pack long, doc binary, place binary, first binary, leaf binary, tokens binary")
    lines = bucketed(lines, "lines", "pack")

    def read(batch: pa.RecordBatch, k: int):
        doc, place, first = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in (1, 2, 3))
        leaf, tokens = (np.frombuffer(batch.column(c)[k].as_py(), U64) for c in (4, 5))
        row, pos, _ = _rows(np.arange(len(doc)), first)
        return batch.column(0)[k].as_py(), doc, place, row, pos, pair(pair(leaf[row], pos.astype(U64)), tokens), leaf, tokens

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pack, doc, _, row, pos, key, _, tokens = read(batch, k)
                later = (pos >= depth) & (tokens != _FIELD)
                if later.any():
                    yield document_counts(pack, key[later], doc[row[later]])[0]

    def templates_of(batch: pa.RecordBatch, k: int):
        """(pack, documents, places, template keys) of the lines with enough fixed tokens."""
        pack, doc, place, row, pos, key, leaf, tokens = read(batch, k)
        fixed = (pos < depth) & (tokens != _FIELD)
        later = np.flatnonzero((pos >= depth) & (tokens != _FIELD))
        found = batch.column(6)[k]
        if found.is_valid and len(later):
            names, slot = np.unique(key[later], return_inverse=True)
            live = np.zeros(len(names), bool)
            live[found.values.to_numpy(zero_copy_only=False)] = True
            fixed[later] = live[slot]
        n = len(doc)
        share = np.bincount(row, fixed, n) / np.maximum(np.bincount(row, minlength=n), 1)
        mixed, total = leaf.copy(), np.zeros(n, U64)
        np.add.at(total, row[fixed], salted(key[fixed], 7))
        mixed = pair(mixed, total)
        enough = share >= fixed_share
        return pack, doc[enough], place[enough], mixed[enough]

    def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pack, doc, _, key = templates_of(batch, k)
                if len(key):
                    yield document_counts(pack, key, doc)[0]

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, found): document and place of the lines to drop, as one number each."""
        for batch in batches:
            for k in range(batch.num_rows):
                pack, doc, place, key = templates_of(batch, k)
                found = batch.column(7)[k]
                if found.is_valid and len(key):
                    names, slot = np.unique(key, return_inverse=True)
                    live = np.zeros(len(names), bool)
                    live[found.values.to_numpy(zero_copy_only=False)] = True
                    live = live[slot]
                    yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([(doc[live] << 32) | place[live]], pa.list_(pa.int64()))], ["pack", "found"])

    tokens = often(lines, lambda some: some.mapInArrow(tokens_of, COUNT_SCHEMA)).withColumnRenamed("found", "tokens_found")
    lines = lines.join(written(tokens, "line-tokens").hint("shuffle_hash"), "pack", "left")
    whole = often(lines, lambda some: some.mapInArrow(templates, COUNT_SCHEMA)).withColumnRenamed("found", "templates_found")
    gone = lines.join(whole.hint("shuffle_hash"), "pack", "left").mapInArrow(dropped, "pack long, found array<long>")

    def kept(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        texts = rows.column(1).to_pylist()
        out_of = {}
        for x in found.to_pylist() if found is not None else ():
            out_of.setdefault(x >> 32, set()).add(x & 0xFFFFFFFF)
        lines = [t.count("\n") + 1 if t else 0 for t in texts]
        for d, places in out_of.items():
            texts[d] = "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in places)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(lines, pa.int64()), pa.array([len(out_of.get(d, ())) for d in range(len(texts))], pa.int64()), pa.array(texts, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text"],
        )

    return map_packs(with_found(packs, gone), kept, "doc_id long, n_lines long, n_dropped long, kept_text string")
