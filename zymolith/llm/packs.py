"""Documents packed into blocks, and keys counted over all blocks.

A pack holds about a megabyte of documents as one compressed row, so that a
Python stage works on whole blocks and a shuffle moves one row a block.  Packs
are written to the shared folder, in buckets of their numbers if need be, before
anything refers to them by number, so what is found for them moves to them.
Within a pack a key is one row however often it occurs there, so a key that
occurs in every document costs a row a pack, not a row an occurrence.  Rows of one
key meet in cells of packs first, and of each cell one row goes on to meet the
other cells, so no task gets a row of every pack.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import bucketed
from .shared import empty_text, written
from .text import blocks

PACK_BYTES = 1 << 20
LEVEL = 6
#: Packs of one cell: so many rows of a key meet in one task at most, and about as many cells after that.
CELL_PACKS = 4096


def packed(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = PACK_BYTES, in_buckets: bool = False) -> DataFrame:
    """A written table (pack, blob): ids and whole texts of ``docs``; in buckets of ``pack`` where it is joined more than once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for a, b in blocks(batch.column(1), most_bytes):
                sink = pa.BufferOutputStream()
                part = batch.slice(a, b - a)
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([squeeze.compress(sink.getvalue())], pa.binary())], ["blob"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text"))
    out = rows.mapInArrow(pack, "blob binary").select(F.monotonically_increasing_id().alias("pack"), "blob")
    return bucketed(out, f"{name}-packs", "pack") if in_buckets else written(out, f"{name}-packs")


def cells_of(packs: DataFrame, most: int | None = None) -> int:
    """How many cells a written table of packs is dealt into."""
    return max(1, math.ceil(packs.count() / (most or CELL_PACKS)))


def unpacked(blob: bytes) -> pa.RecordBatch:
    """The (id, text) rows of a pack."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return pa.ipc.open_stream(raw).read_next_batch()


def map_packs(packs: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls ``work(pack, id/text batch, found)`` for each pack row; ``found`` is its list column, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = batch.column(2)[k].values if batch.num_columns > 2 and batch.column(2)[k].is_valid else None
                yield from work(batch.column(0)[k].as_py(), unpacked(batch.column(1)[k].as_py()), found)

    return packs.mapInArrow(run, schema)


def in_order(keys: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, whether each in that order equals the one before it); with ``check`` a key is both."""
    order, same = np.argsort(keys), np.zeros(len(keys), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    if check is not None and (check[order[1:]][same[1:]] != check[order[:-1]][same[1:]]).any():
        order = np.lexsort((check, keys))
        same[1:] = (keys[order[1:]] == keys[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    return order, same


def key_rows(pack: int, keys: np.ndarray, at: np.ndarray, check: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a distinct key: (key, check, pack, at of one of its occurrences, times: 1, or 2 if it occurs again in the pack).

    ``check``: 64 more bits of the key, if given.
    """
    order, same = in_order(keys, check)
    begin = np.flatnonzero(~same)
    index, counts = order[begin], np.diff(np.append(begin, len(keys)))
    extra = np.zeros(len(index), np.int64) if check is None else check[index].view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[index].view(np.int64)), pa.array(extra), pa.array(np.full(len(index), pack, np.int64)), pa.array(at[index].astype(np.int32)), pa.array(np.minimum(counts, 2).astype(np.int32))],
        ["key", "check", "pack", "at", "times"],
    )


KEY_SCHEMA = "key long, check long, pack long, at int, times int"
_KEY = ("key", "check")


def _met(rows: DataFrame, cells: int, keys: tuple[str, ...], amount: Column, least: int) -> DataFrame:
    """``rows`` with ``enough``: whether the amounts of all rows of their key reach ``least``.

    Amounts are at least 1.  Cells of a key are judged first; rows of a cell that
    reaches it need no other cell, but one of them stands for it, and meets the rows
    of the cells that do not: fewer than ``least`` from each.
    """
    cell = F.pmod(F.xxhash64("pack"), F.lit(cells)).cast("int")
    rows = rows.withColumn("cell", cell)
    own = Window.partitionBy(*keys, "cell") if cells > 1 else Window.partitionBy(*keys)
    rows = rows.withColumn("enough", F.sum(amount).over(own) >= least)
    if cells == 1:
        return rows
    stands = F.col("enough") & (F.row_number().over(own.orderBy("pack")) == 1)
    rows = rows.withColumn("share", F.when(stands, least).when(~F.col("enough"), amount).otherwise(0))
    apart = F.when(F.col("share") > 0, F.lit(-1)).otherwise(F.hash("pack", "key"))  # the others are dealt out
    rows = rows.withColumn("apart", apart)
    total = F.sum("share").over(Window.partitionBy(*keys, "apart"))
    return rows.withColumn("enough", F.col("enough") | (total >= least))


def repeated_elsewhere(rows: DataFrame, cells: int) -> DataFrame:
    """(pack, found): for each pack, the ``at`` of keys that it has once and another pack has too."""
    again = _met(rows, cells, _KEY, F.lit(1), 2).where(F.col("enough") & (F.col("times") == 1))
    return again.groupBy("pack").agg(F.collect_list("at").alias("found"))


def document_counts(pack: int, keys: np.ndarray, doc: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row a distinct key, with the number of the pack's documents that have it; ``at`` numbers the keys."""
    names, slot = np.unique(keys, return_inverse=True)
    both = np.unique(slot.astype(np.int64) * (int(doc.max(initial=0)) + 1) + doc)
    n = np.bincount(both // (int(doc.max(initial=0)) + 1), minlength=len(names))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(names.view(np.int64)), pa.array(np.full(len(names), pack, np.int64)), pa.array(np.arange(len(names), dtype=np.int32)), pa.array(n.astype(np.int64))],
        ["key", "pack", "at", "n"],
    )
    return batch, slot


COUNT_SCHEMA = "key long, pack long, at int, n long"


def in_many_documents(counts: DataFrame, cells: int, least: int) -> DataFrame:
    """(pack, found): for each pack, the ``at`` of its keys that at least so many documents have."""
    return _met(counts, cells, ("key",), F.col("n"), least).where("enough").groupBy("pack").agg(F.collect_list("at").alias("found"))


def with_found(packs: DataFrame, found: DataFrame) -> DataFrame:
    """(pack, blob, found): the packs stay in their buckets, and what is found for them is looked up in memory."""
    return packs.join(found.hint("shuffle_hash"), "pack", "left").select("pack", "blob", "found")
