"""Exact deduplication over an extendible-hash index in the shared folder.

1. The texts are read once into narrow rows: id, 64-bit hash and SHA-256.  One
   index entry per hash says how many rows have it; entries are counted before
   they are shuffled, so a text that a third of the rows share is one entry.
2. The directory: a bucket holds the entries that share a prefix of their hash.
   It begins with as many bits as an even spread needs; then buckets with more
   entries than the capacity are split by one more bit, round by round, until
   none is overfull.  The directory has a cell for each prefix of the greatest
   depth in use, and says which bucket owns it.
3. Texts of entries with company go to the owner of their bucket, rows of equal
   text (compared by their bytes) as one.  The owner chains the texts of one hash
   and writes each link with the id that stays and the number of rows; two texts
   of a chain with one SHA-256 would end the job.  These rows are the index.
4. Every row looks its hash up in the directory, and its SHA-256 in the chain of
   the bucket that it finds there.  A chain has no two texts of one SHA-256, so
   the link that answers is the row's own text.  What stays, and the size of the
   group, are what the link says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import empty_text, small_side, written

#: Entries of a bucket before it is split.
CAPACITY = 1 << 15
#: Sides of more rows than this are joined by a shuffle.
BROADCAST_ROWS = 1 << 18

_H, _SHA, _ID, _KEEP, _N = "__zy_hash", "__zy_sha", "__zy_id", "__zy_keep", "__zy_n"


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the hash."""
    return F.shiftrightunsigned(F.col(_H), 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth) for each prefix of ``depth`` bits in use, and ``depth``.

    ``entries``: distinct hashes.  ``bucket`` is the first cell of the bucket's
    range of cells; no bucket has more than ``capacity`` entries.
    """
    depth = max(0, math.ceil(math.log2(max(1, entries.count() / capacity))))
    live, buckets = entries, None
    while True:
        level = written(live.groupBy(_prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), f"exact-level-{depth}")
        fit = level.where(F.col("n") <= capacity).select("prefix", F.lit(depth).alias("local_depth"))
        buckets = fit if buckets is None else buckets.unionByName(fit)
        overfull = level.where(F.col("n") > capacity).select("prefix")
        if overfull.isEmpty():
            break
        live = live.withColumn("prefix", _prefix(depth)).join(small_side(overfull, BROADCAST_ROWS), "prefix", "left_semi").drop("prefix")
        depth += 1
    cells = entries.select(_prefix(depth).alias("cell")).distinct()
    # a cell lies in one bucket, of some depth up to that of the directory
    above = cells.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - local_depth)"))
    bucket = F.expr(f"shiftleft(prefix, {depth} - local_depth)").alias("bucket")
    return written(above.join(buckets, ["local_depth", "prefix"]).select("cell", bucket, "local_depth"), "exact-directory"), depth


def _rows(docs: DataFrame, id_col: str, text_col: str, text_hash: Column | None, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with id, hash and SHA-256 of the text."""
    text = empty_text(text_col)
    rows = docs.select(*columns, F.col(id_col).alias(_ID), text.alias("__zy_text"))
    hashed = F.xxhash64("__zy_text") if text_hash is None else text_hash
    return rows.withColumns({_H: hashed, _SHA: F.unhex(F.sha2("__zy_text", 256))})


class Index:
    """The directory and the chains of texts that more than one row has."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, capacity: int, text_hash: Column | None):
        rows = _rows(docs, id_col, text_col, text_hash)
        narrow = rows.select(F.monotonically_increasing_id().alias("row"), _ID, _H, _SHA)
        self.rows = written(narrow, "exact-rows")
        entries = written(self.rows.groupBy(_H).agg(F.count(F.lit(1)).alias("n")), "exact-entries")
        self.cells, self.depth = directory(entries.select(_H), capacity)
        company = entries.where("n > 1").select(_H)
        suspects = rows.join(small_side(company, BROADCAST_ROWS), _H, "left_semi")
        texts = suspects.groupBy(_H, "__zy_text").agg(F.count(F.lit(1)).alias(_N), F.max(_ID).alias(_KEEP))
        self.near = small_side(self.cells.select("cell", "bucket"), BROADCAST_ROWS)
        texts = texts.select(_H, F.unhex(F.sha2("__zy_text", 256)).alias(_SHA), _N, _KEEP)
        owned = self.owned(texts).repartition("bucket")
        chain = Window.partitionBy("bucket", _H).orderBy(_SHA)
        owned = owned.withColumn("link", F.row_number().over(chain)).withColumn("before", F.lag(_SHA).over(chain))
        clash = F.raise_error(F.lit("two texts with one SHA-256")).cast("binary")
        owned = owned.withColumn(_SHA, F.when(F.col("before") == F.col(_SHA), clash).otherwise(F.col(_SHA)))
        self.links = written(owned.select("bucket", _H, "link", _SHA, _KEEP, _N).sortWithinPartitions("bucket", _H, "link"), "exact-index")
        self.answers = small_side(self.links.where(F.col(_N) > 1).drop("link"), BROADCAST_ROWS)

    def owned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket that the directory gives their hash."""
        cell = rows.withColumn("cell", _prefix(self.depth))
        return cell.join(self.near, "cell").drop("cell")

    def linked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the id that stays and the size of the group, as the links of their buckets say."""
        out = self.owned(rows).join(self.answers, ["bucket", _H, _SHA], "left").drop("bucket")
        alone = F.col(_N).isNull()
        return out.withColumns({_KEEP: F.when(alone, F.col(_ID)).otherwise(F.col(_KEEP)), _N: F.coalesce(_N, F.lit(1)).cast("long")})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, text_hash: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are.  Of equal texts the row with the largest
    id stays; of rows that share that id and the text, one.  Null text counts as
    empty; all empty texts are one group.  A null id is below all others.  Other
    columns are ignored; an empty table gives an empty result.  ``text_hash`` (an
    expression over a column ``__zy_text``) replaces the hash of the index; a weak
    one makes longer chains, not other results.
    """
    index = Index(docs, id_col, text_col, capacity, text_hash)
    out = index.linked(index.rows)
    stays = F.col(_ID).eqNullSafe(F.col(_KEEP))
    first = out.where(stays & (F.col(_N) > 1)).groupBy(_H, _SHA).agg(F.min("row").alias("first"))
    out = out.join(small_side(first, BROADCAST_ROWS), [_H, _SHA], "left")
    return out.select(
        F.col(_ID).alias("doc_id"),
        F.col(_KEEP).alias("keep_id"),
        F.col(_N).alias("group_size"),
        (stays & (F.coalesce("first", "row") == F.col("row"))).alias("kept"),
        F.lower(F.hex(_SHA)).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each text.

    It is the row that ``exact_dedup`` keeps: null and empty texts are one text, a
    null id is below all others; of rows with one id and text any one stays.  An
    empty table gives an empty result; columns of any other name are carried.
    """
    index = Index(docs, id_col, text_col, CAPACITY, None)
    stays = F.col(_ID).eqNullSafe(F.col(_KEEP))
    out = index.linked(_rows(docs, id_col, text_col, None, *docs.columns).drop("__zy_text")).where(stays)
    twice = index.linked(index.rows).where(stays & (F.col(_N) > 1)).groupBy(_H, _SHA).count().where("count > 1").select(_H, _SHA)
    if not twice.isEmpty():
        twice = small_side(written(twice, "exact-twice"), BROADCAST_ROWS)
        again = out.join(twice, [_H, _SHA], "left_semi").dropDuplicates([_H, _SHA])
        out = out.join(twice, [_H, _SHA], "left_anti").unionByName(again)
    return out.select(*docs.columns)
