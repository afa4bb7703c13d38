"""Sides of joins whose size is counted before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side that is small by meaning is broadcast.
BROADCAST_ROWS = 1 << 16


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    Beyond the limit the join is a shuffled one, whose hot keys adaptive
    execution splits.
    """
    return F.broadcast(df) if at_most(df, rows) else df
