"""Codes of vectors from weighted Lloyd rounds over distinct integer parts.

Components become integers and vectors are cut into equal parts.  Equal parts of
one position are one row with a weight; the rounds only read these distinct
rows.  A task sums its rows by codebook entry, so a round shuffles a row an entry
and component a task, and only the entries of the codebooks come to the driver.
Codes and errors are joined back to the vectors by the parts themselves; parts
that are heavy by their weight meet the vectors by a broadcast whose size the
weights bound, so no key of the shuffled join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_side, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components beyond are counted as this; a million times what embeddings have.
LARGEST = 1 << 62
#: Up to this size of a component, squares of differences fit 64 bits with room for parts of 256.
_NARROW = 1 << 26
#: At most so many distinct parts are heavy: each has that share of all parts.
HEAVY_PARTS = 1 << 14
#: Labels beyond so many meet the rows by a shuffled join.
LABEL_ROWS = 1 << 18
_LONG = (1 << 63) - 1


def finite(vector: str) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component, within 62 bits."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))))


def rows_of(part: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of ``book``, squared distance) of each row, ties to the lower index; exact at any size."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) > _NARROW or x.shape[1] > 256:
        x, book = x.astype(object), book.astype(object)
    best, index = ((x - book[0]) ** 2).sum(1), np.zeros(len(x), np.int64)
    for k in range(1, len(book)):
        far = ((x - book[k]) ** 2).sum(1)
        less = np.asarray(far < best, bool)
        best, index = np.where(less, far, best), np.where(less, k, index)
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """One matrix (entries x width) of integers for each part position."""

    books: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position within the part."""
        return hashlib.sha256(",".join(str(int(c)) for b in self.books for e in b for c in e).encode()).hexdigest()


def assigned_sums(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(pos, entry, dim, total): weighted sums of the parts nearest to each entry; ``dim`` -1 has the weights."""
    width = books.width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros((len(b), width + 1), object) for p, b in enumerate(books.books)}
        for batch in batches:
            pos, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = rows_of(batch.column(1), width)
            for p in np.unique(pos):
                mine = pos == p
                own, w = x[mine], weight[mine]
                index, _ = nearest(own, books.books[p])
                own = np.concatenate([own, np.ones((len(own), 1), np.int64)], 1)
                if (int(np.abs(own).max()) + 1) * int(w.sum()) > _LONG:
                    own, w = own.astype(object), w.astype(object)
                own = own * w[:, None]
                for e in np.unique(index):
                    total[p][e] += own[index == e].sum(0)
        rows = [(p, e, d if d < width else -1, v) for p, t in total.items() for e in np.flatnonzero(t[:, width] != 0) for d, v in enumerate(t[e])]
        if rows:
            p, e, d, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(d, pa.int32()), pa.array([Decimal(int(y)) for y in v], pa.decimal128(38, 0))], ["pos", "entry", "dim", "total"])

    sums = distinct.select("pos", "part", "weight").mapInArrow(work, "pos int, entry int, dim int, total decimal(38,0)")
    return sums.groupBy("pos", "entry", "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def lloyd_round(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of the mean of its parts; entries that no part is nearest to stay."""
    new = [b.copy() for b in books.books]
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in assigned_sums(distinct, books).collect():  # as many rows as the codebooks have components
        found.setdefault((r.pos, r.entry), {})[r.dim] = int(r.total)
    for (p, e), sums in found.items():
        for d in range(books.width):
            new[p][e, d] = sums[d] // sums[-1]
    return Codebooks(tuple(new))


def coded(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(pos, part, weight, code, error) of the distinct parts."""
    width = books.width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, x = batch.column(0).to_numpy(), rows_of(batch.column(1), width)
            code, error = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                mine = np.flatnonzero(pos == p)
                index, far = nearest(x[mine], books.books[p])
                code[mine], error[mine] = index, np.minimum(far, _LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["pos", "part", "weight", "code", "error"])

    return distinct.select("pos", "part", "weight").mapInArrow(work, "pos int, part array<bigint>, weight bigint, code int, error bigint")


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row per row whose vector is complete.

    ``code``: two hex digits a part, the index of its codebook's entry; ``error``:
    squared distances summed over the parts; ``label_error``: errors summed over
    equal labels, nulls together; ``codebooks_sha256``: of all final entries.

    Rows whose vector is null or has a null or non-finite component are left out.
    The first codebooks are the parts of the ``entries`` smallest ids (null ids come
    last; rows with one id in order of their vectors), or of as many as there are.
    Vectors shorter than the longest, or of a length that ``parts`` does not
    divide, count as filled up with zeros; a vector of length 0 too.  Components
    of 2**62 and more after scaling count as 2**62; sums beyond a long as the
    largest long.  Repeated rows are rows of their own.  Other columns are
    ignored.  A table without complete vectors gives an empty result.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries are 1 to 256, parts at least 1, rounds at least 0")
    kept = vectors.where(finite(vector_col)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), integers(vector_col, scale).alias("v"))
    kept = written(kept, "codes-vectors")
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("v"))
    kept = kept.withColumn("v", F.concat("v", missing))

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    seeds = np.array([r.v for r in first] or [[0] * (width * parts)], np.int64).reshape(-1, parts, width)
    books = Codebooks(tuple(seeds[:, p].copy() for p in range(parts)))

    pieces = kept.select("row", "vec_id", "label", F.posexplode(F.array(*[F.slice("v", 1 + p * width, width) for p in range(parts)])).alias("pos", "part"))
    distinct = written(pieces.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")), "codes-distinct")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    table = written(coded(distinct, books), "codes-table")

    out = joined_codes(pieces, table, parts)
    by_label = written(out, "codes-rows")
    total = by_label.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    total = total.withColumnRenamed("label", "its_label")
    out = by_label.join(small_side(total, LABEL_ROWS), F.col("label").eqNullSafe(F.col("its_label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def joined_codes(pieces: DataFrame, table: DataFrame, parts: int, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """(vec_id, label, code, error) by row: the parts of each row meet their codes.

    A part with more than its share of all weights is heavy; there are fewer than
    ``heavy_parts`` of them, so they are broadcast, and their rows go through the
    shuffled join under a key of their own, which nothing meets.
    """
    share = table.agg(F.sum("weight")).first()[0] or 0
    heavy = table.where(F.col("weight") * heavy_parts > share).select("pos", "part", F.col("code").alias("heavy_code"), F.col("error").alias("heavy_error"))
    light = table.where(F.col("weight") * heavy_parts <= share).select(F.col("pos").cast("long").alias("deal"), "part", "code", "error")
    met = pieces.join(F.broadcast(heavy), ["pos", "part"], "left")
    found = F.col("heavy_code").isNotNull()
    met = met.withColumn("deal", F.when(found, -1 - F.col("row")).otherwise(F.col("pos").cast("long"))).withColumn("part", F.when(found, F.array().cast("array<bigint>")).otherwise(F.col("part")))
    met = met.join(light, ["deal", "part"], "left")
    code = F.coalesce("heavy_code", "code").cast("decimal(20,0)")
    rows = met.groupBy("row", "vec_id", "label").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.lpad(F.lower(F.hex(code.cast("long"))), 2, "0").alias("digits")))).alias("digits"),
        F.least(F.sum(F.coalesce("heavy_error", "error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("error"),
    )
    return rows.select("vec_id", "label", F.array_join(F.transform("digits", lambda d: d["digits"]), "").alias("code"), "error")
