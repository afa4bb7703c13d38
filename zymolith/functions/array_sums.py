"""Sums of equally shaped arrays over all tasks of a job."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose arrays are added in one group before the groups' sums are added.
FAN_IN = 64


def array_sums(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[tuple[int, ...], np.ndarray]]], keys: Sequence[str]) -> DataFrame:
    """(keys long, cells binary): sums of the float arrays that ``work`` gives for each key in each task.

    ``work`` gets a task's batches and gives each key at most once, the array of a key in one
    shape in all tasks.  Arrays of FAN_IN tasks meet first, then their sums, so no
    task adds more than the square root of many; each group is added in order of its
    tasks, so a rerun gives the same bits.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for key, cells in work(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(cells, np.float64).tobytes()], pa.binary())], [*keys, "part", "cells"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group["part"].to_numpy(), kind="stable")
        total = None
        for k in order:
            own = np.frombuffer(group["cells"][int(k)].as_py(), np.float64)
            total = own.copy() if total is None else total + own
        return pa.table({**{n: pa.array([v.as_py()], pa.int64()) for n, v in zip(names, key, strict=True)}, "cells": pa.array([total.tobytes()], pa.binary())})

    schema = ", ".join(f"{k} long" for k in keys)
    out = rows.mapInArrow(run, f"{schema}, part long, cells binary")
    names = [*keys, "part"]
    some = out.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy(*names).applyInArrow(add, f"{schema}, part long, cells binary")

    def last(key: tuple, group: pa.Table) -> pa.Table:
        return add((*key, group["part"][0]), group).drop_columns(["part"])

    return some.groupBy(*keys).applyInArrow(last, f"{schema}, cells binary")


def cells_of(row_cells: bytes, shape: Sequence[int]) -> np.ndarray:
    return np.frombuffer(row_cells, np.float64).reshape(shape)
