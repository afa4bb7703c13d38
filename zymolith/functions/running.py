"""Running sums and ordinals over an ordered key without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Adds ``out = sum(in)`` over each group of ``keys`` from the greatest ``order`` down to the row's own.

    ``df`` has one row per (keys, order).  Each group is cut at its own quantiles
    into ``buckets`` (as many as the session has shuffle partitions) of about as many
    rows each, wherever its values pile up; a row adds the sum of the buckets above
    its own to the sum within its bucket.
    """
    keys = list(keys)
    buckets = buckets or max(2, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    value = F.col(order).cast("double")
    shares = [k / buckets for k in range(1, buckets)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, shares, 10 * buckets).alias("_cuts"))
    cut = df.join(edges, keys).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < value))).drop("_cuts")
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    above = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{o}").over(above), F.lit(0)).alias(f"_a_{o}") for o in sums])
    within = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.withColumns({f"_w_{o}": F.sum(c).over(within) for o, c in sums.items()}).join(totals, [*keys, "_bucket"])
    out = out.withColumns({o: F.col(f"_w_{o}") + F.col(f"_a_{o}") for o in sums})
    return out.drop("_bucket", *[f"_{p}_{o}" for p in "aw" for o in sums])


def in_parts(df: DataFrame, order: Sequence[Column | str], name: str = "_part") -> DataFrame:
    """A written table of ``df`` in ranges of ``order``, numbered by ``name``; rows that tie are spread by a hash of the whole row."""
    rows = df.withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(*order, "_tie")
    return written(rows.withColumn(name, F.spark_partition_id()), "parts")


def ordinals(df: DataFrame, order: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """Adds dense ordinals from 0 in the given order; ties in an order that depends on the rows only.

    Rows are numbered within ranges; a range adds the rows of the ranges before
    it, a table of one row a range.
    """
    rows = in_parts(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie")) - 1
    out = rows.withColumn("_k", within).join(F.broadcast(starts), "_part")  # one row a range
    return out.withColumn(name, (F.col("_start") + F.col("_k")).cast("long")).drop("_part", "_tie", "_k", "_start")


def at_least_one(x: Column) -> Column:
    """``x`` with zero replaced by one: the denominator rule of the correlation coefficient."""
    return F.when(x == 0, F.lit(1.0)).otherwise(x)
