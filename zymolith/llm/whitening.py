"""Whitening of embeddings from a tiled covariance.

Pairs of dimensions are dealt to tiles.  The distinct vectors are cut into
blocks of rows and each block into blocks of columns; the two column blocks of a
tile meet by (row block, tile), are multiplied, and each task sums its products
by tile before the sums of all tasks are added.  Components are integers and are
centred by the floor of their mean before they are multiplied, so all sums are
exact and a rerun gives the same bits; the fraction of the mean is taken off
the exact covariance.  The driver gets one number for each pair of dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .vector_codes import finite, rows_of

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Dimensions of one side of a tile.
TILE = 32
#: Rows of a block.
BLOCK_ROWS = 4096
#: Components beyond are counted as this, so that centred ones fit 62 bits.
LARGEST = 1 << 60
_LONG = (1 << 63) - 1
_EXACT = 1 << 53
_COLUMNS = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]


def _integers(batch: np.ndarray) -> np.ndarray:
    """The centred rows in the narrowest type that holds them."""
    most = int(np.abs(batch).max(initial=0))
    return batch.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of integer matrices, exact; in floating point where all sums stay below 2**53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * len(a)
    if most < _EXACT:
        return np.rint(a.astype(float).T @ b.astype(float)).astype(np.int64)
    return a.astype(object).T @ b.astype(object)


def _numbers(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def dimension_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension); a task gives one row a dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for batch in batches:
            x = rows_of(batch.column(0), dims)
            small = int(np.abs(x).max(initial=0)) * max(1, len(x)) < _LONG
            total += (x if small else x.astype(object)).sum(0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), _numbers([n, *total])], ["dim", "total"])

    rows = fit.select("x").mapInArrow(work, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    by = {r.dim: int(r.total) for r in rows}
    return by.get(-1, 0), [by.get(d, 0) for d in range(dims)]


def tiled_products(fit: DataFrame, middle: np.ndarray, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, total) with i <= j: exact sums of (x_i - middle_i) * (x_j - middle_j) over the rows of ``fit``."""
    dims = len(middle)
    spans = [(a, min(a + tile, dims)) for a in range(0, dims, tile)]
    narrow = {2: np.int16, 4: np.int32, 8: np.int64}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), dims)
            for at in range(0, len(x), block_rows):
                z = x[at : at + block_rows] - middle
                first = batch.column(0)[at].as_py()
                columns = [_integers(z[:, a:b]) for a, b in spans]
                out = [(first, a, b, side, len(z), columns[c].itemsize, columns[c].tobytes()) for a in range(len(spans)) for b in range(a, len(spans)) for side, c in ((0, a), (1, b)) if side == 0 or a != b]
                for row in out:  # one column block a batch bounds the memory
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:6]] + [pa.array([row[6]], pa.binary())], ["block", "a", "b", "side", "rows", "bytes", "cells"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        waits: tuple | None = None  # the left column block whose right one comes next
        for batch in batches:
            for r in range(batch.num_rows):
                block, a, b, side, rows, size = (batch.column(k)[r].as_py() for k in range(6))
                cells = np.frombuffer(batch.column(6)[r].as_buffer(), narrow[size]).reshape(rows, -1).astype(np.int64)
                if side == 0 and a != b:
                    waits = (block, a, b, cells)
                    continue
                if side == 1 and (waits is None or waits[:3] != (block, a, b)):
                    raise RuntimeError("a column block came without its partner")
                got = exact_product(cells if side == 0 else waits[3], cells)
                total[a, b] = total.get((a, b), 0) + got.astype(object)
        for (a, b), t in sorted(total.items()):
            i, j = np.meshgrid(np.arange(*spans[a], dtype=np.int32), np.arange(*spans[b], dtype=np.int32), indexing="ij")
            upper = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[upper]), pa.array(j[upper]), _numbers(t[upper])], ["i", "j", "total"])

    dealt = fit.select("row", "x").mapInArrow(deal, "block long, a long, b long, side long, rows long, bytes long, cells binary")
    met = dealt.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b", "side")
    sums = met.mapInArrow(multiply, "i int, j int, total decimal(38,0)")
    return sums.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


@dataclass(frozen=True)
class Whitening:
    """What takes integer vectors to their whitened components."""

    n: int
    sums: tuple[int, ...]
    #: Unit eigenvectors, one a column, by falling eigenvalue.
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """Floor of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the mean is beyond its floor, in n-ths."""
        return np.array([s % self.n for s in self.sums], object)

    def usable(self) -> np.ndarray:
        """Whether a component's variance is more than rounding."""
        return self.values > max(self.values.max(initial=0), 0) * len(self.sums) * np.finfo(float).eps

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components; NaN where a component has no variance."""
        centred = (x - self.middle).astype(float) - self.rest.astype(float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable(), centred @ self.axes / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)**2 over the dimensions, exact; at most the largest long."""
        z = x - self.middle
        most = (int(np.abs(z).max(initial=0)) + 1) * self.n
        if most**2 * max(1, z.shape[1]) < _LONG:
            return ((z * self.n - self.rest.astype(np.int64)) ** 2).sum(1)
        exact = ((z.astype(object) * self.n - self.rest) ** 2).sum(1)
        return np.array([min(int(v), _LONG) for v in exact], np.int64)


def fitted(fit: DataFrame, dims: int, components: int = COMPONENTS, tile: int = TILE) -> Whitening | None:
    """Whitening from the rows (row, x) of a written table of distinct vectors; None without rows or dimensions."""
    n, sums = dimension_sums(fit, dims) if dims else (0, [])
    if not n:
        return None
    middle, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    cov = np.zeros((dims, dims))
    for r in tiled_products(fit, middle, tile).toLocalIterator():  # a number for each pair of dimensions
        cov[r.i, r.j] = cov[r.j, r.i] = float(Fraction(int(r.total) * n - rest[r.i] * rest[r.j], n * n))
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), axes, values[order], float(np.trace(cov)))


def identity_error(fit: DataFrame, model: Whitening, dims: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity, over usable components.

    Whitened rows are centred already; their mean, which is rounding, is taken off too.
    """
    use = np.flatnonzero(model.usable())
    if not len(use):
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(use) + 1, len(use)))
        for batch in batches:
            y = model.project(rows_of(batch.column(0), dims))[:, use]
            total[:-1] += y.T @ y
            total[-1] += y.sum(0)
        i, j = np.meshgrid(*map(np.arange, total.shape), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "total"])

    rows = fit.select("x").mapInArrow(work, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((len(use) + 1, len(use)))
    for r in rows:
        total[r.i, r.j] = r.total
    mean = total[-1] / model.n
    return float(np.abs(total[:-1] / model.n - np.outer(mean, mean) - np.eye(len(use))).max())


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: float = SCALE,
    shift: int = SHIFT,
    tile: int = TILE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per complete vector and component.

    Components are floor(scale * c) + shift.  Each distinct vector counts once in
    the ``n`` rows that means and covariances are made of; all rows are projected.

    Rows whose vector is null or has a null or non-finite component are left out.
    Vectors shorter than the longest count as filled up with zeros before they are
    shifted; with fewer dimensions than components there are as many components
    as dimensions.  A component without variance has a null ``whitened``, and so
    have all if there is one distinct vector; ``identity_error`` leaves them out and
    is null if no other is there; ``explained`` is then 0 for all.  Equal
    eigenvalues take the eigenvectors in the order of the solver, the same for all
    rows.  Components beyond 2**60 count as 2**60, ``deviation`` beyond a long as the
    largest long.  Repeated rows and null ids are rows of their own; other columns
    are ignored.  A table without complete vectors, or with vectors of length 0
    only, gives an empty result.
    """
    whole = F.transform(vector_col, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * scale))) + F.lit(shift))
    kept = written(vectors.where(finite(vector_col)).select(F.col(id_col).alias("vec_id"), whole.alias("x")), "white-vectors")
    dims = kept.agg(F.max(F.size("x"))).first()[0] or 0
    kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("x"))))
    fit = written(kept.select("x").distinct().select(F.monotonically_increasing_id().alias("row"), "x"), "white-fit")
    model = fitted(fit, dims, components, tile)
    schema = T.StructType([kept.schema["vec_id"], *(T.StructField(name, kind) for name, kind in _COLUMNS)])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model, dims)
    count = len(model.values)
    explained = np.clip(model.values, 0, None) / model.trace if model.trace > 0 else np.zeros(count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_ROWS // count)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = rows_of(part.column(1), dims)
                y, n = model.project(x), len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(n), count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * count, model.n, np.int64)),
                        pa.array(np.repeat(model.deviation(x), count)),
                        pa.array(y.ravel(), mask=np.isnan(y.ravel())),
                        pa.array(np.tile(explained, n)),
                        pa.array(np.full(n * count, math.nan if error is None else error), mask=np.full(n * count, error is None)),
                    ],
                    schema.names,
                )

    return kept.mapInArrow(work, schema)
