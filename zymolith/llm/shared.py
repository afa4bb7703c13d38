"""Tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch_dir, written

__all__ = ["at_most", "empty_text", "scratch_dir", "small_side", "written"]


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    Beyond the limit the join is a shuffled one, whose hot keys adaptive
    execution splits.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
