"""Ordered integer sets: islands, gaps, segments and alignment positions.

Input rows are (keys..., value): one row a member.  The windows are over one
key's members, one residue set, which is small however many keys there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], value: str = "value", gap: int = 1) -> DataFrame:
    """(keys, island, lo, hi, n): maximal runs in which neighbours differ by at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    rows = rows.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("_new").over(w))
    return rows.groupBy(*keys, "island").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))


def compressed(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, selection): 1, 2, 3, 5 becomes ``1-3+5``."""
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    parts = islands(df, keys, value).select(*keys, F.struct("lo", text.alias("t")).alias("p"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "+").alias("selection"))


def parse_selection(selection: Column) -> Column:
    """The inverse of ``compressed``: an array of integers."""
    ends = F.transform(F.split(selection, r"\+"), lambda p: F.split(p, "-"))
    runs = F.transform(ends, lambda e: F.sequence(F.element_at(e, 1).cast("int"), F.element_at(e, -1).cast("int")))
    return F.when(selection == "", F.array().cast("array<int>")).otherwise(F.flatten(runs))


def long_segments(df: DataFrame, keys: Sequence[str], least_span: int, gap: int = 0, value: str = "value") -> DataFrame:
    """Islands with breaks above max(1, gap) whose span hi - lo is at least ``least_span``."""
    return islands(df, keys, value, max(1, gap)).where(F.col("hi") - F.col("lo") >= least_span)


def has_long_segment(df: DataFrame, keys: Sequence[str], least_span: int, gap: int = 0, value: str = "value") -> DataFrame:
    return long_segments(df, keys, least_span, gap, value).select(*keys).distinct()


def gap_filled(df: DataFrame, keys: Sequence[str], gap: int = 5, value: str = "value") -> DataFrame:
    """Adds the values between neighbours that differ by at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = df.select(*keys, value).distinct().withColumn("_before", F.lag(value).over(w))
    start = F.when(F.col("_before") + gap >= F.col(value), F.col("_before") + 1).otherwise(F.col(value))
    return rows.select(*keys, F.explode(F.sequence(start, F.col(value))).alias(value))


def longest_segment(df: DataFrame, blockers: DataFrame, keys: Sequence[str], gap: int = 5, value: str = "value") -> DataFrame:
    """(keys, value) of the island with most members, small gaps filled; ties: the first.

    Neighbours that differ by more than one are parted only if a value of
    ``blockers`` lies between them.
    """
    keys = list(keys)
    both = df.select(*keys, value).distinct().withColumn("_block", F.lit(0)).unionByName(blockers.select(*keys, value).distinct().withColumn("_block", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(value, "_block")
    rows = both.withColumn("island", F.sum("_block").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_block = 0")
    sizes = rows.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(*keys).agg(F.max_by("island", F.struct("n", -F.col("island"))).alias("island"))
    return gap_filled(rows.join(best, [*keys, "island"], "left_semi"), keys, gap, value)


def halved(lo: int, hi: int, most_span: int) -> list[tuple[int, int]]:
    """[lo, hi] cut at its numeric middle again and again until spans are at most ``most_span``."""
    if hi - lo <= most_span:
        return [(lo, hi)]
    middle = (lo + hi) // 2
    return halved(lo, middle, most_span) + halved(middle + 1, hi, most_span)


def halved_segments(segments: DataFrame, most_span: int) -> DataFrame:
    """Segments (..., lo, hi) cut in halves until their span is at most ``most_span``.

    Halving is level by level: a segment in parts of equal depth only where it is
    still too long, so each level is one projection and the number of levels is the
    logarithm of the longest span.
    """
    longest = segments.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    out = segments
    while longest is not None and longest > most_span:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        parts = F.when(F.col("hi") - F.col("lo") > most_span, F.array(F.struct(F.col("lo").cast("long").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").cast("long").alias("hi"))))
        parts = parts.otherwise(F.array(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))))
        rest = [c for c in segments.columns if c not in ("lo", "hi")]
        out = out.select(*rest, F.explode(parts).alias("_p")).select(*rest, "_p.lo", "_p.hi")
        longest //= 2
    return out


def alignment_positions(df: DataFrame, key: str, original: str, aligned: str, gap: str = "-") -> DataFrame:
    """(key, original_pos, aligned_pos), from 0, for the residues of an aligned text; blanks of the original are skipped."""
    letters = df.select(key, F.posexplode(F.split(F.regexp_replace(aligned, r"\s+", ""), "")).alias("aligned_pos", "c")).where(F.col("c") != "")
    w = Window.partitionBy(key).orderBy("aligned_pos")
    residues = letters.where(F.col("c") != gap).withColumn("_n", F.row_number().over(w) - 1)
    source = df.select(key, F.posexplode(F.split(original, "")).alias("original_pos", "o")).where(~F.col("o").isin("", " "))
    source = source.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("original_pos")) - 1)
    return residues.join(source, [key, "_n"]).select(key, "original_pos", "aligned_pos")


def two_nearest_mean(known: DataFrame, wanted: DataFrame, keys: Sequence[str], at: str = "at", value: str = "value") -> DataFrame:
    """(keys, at, value): mean of the two nearest known values in one dimension, halves to even; ties: the lower place.

    The two nearest are among two known places on either side.  A known place knows
    the one before and the one after it, and a sweep in each direction carries the
    last one seen along, so memory does not grow with the group.
    """
    keys = list(keys)
    own = F.struct(F.col(at).alias("p"), F.col(value).cast("double").alias("v"))
    beside = Window.partitionBy(*keys).orderBy(at, value)
    rows = known.select(*keys, at, F.array(own, F.lag(own).over(beside)).alias("_low"), F.array(own, F.lead(own).over(beside)).alias("_high"), F.lit(0).alias("_want"))
    rows = rows.unionByName(wanted.select(*keys, at, F.lit(1).alias("_want")), allowMissingColumns=True)
    frame = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*keys).orderBy(at, "_want").rowsBetween(*frame)
    down = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_want")).rowsBetween(*frame)
    none = F.array().cast("array<struct<p:double,v:double>>")
    near = F.concat(*[F.coalesce(F.transform(F.last(c, ignorenulls=True).over(w), lambda x: F.when(x.isNotNull(), F.struct(x["p"].cast("double").alias("p"), x["v"].alias("v")))), none) for c, w in (("_low", up), ("_high", down))])
    near = F.transform(F.filter(near, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x["p"] - F.col(at)).alias("d"), x["p"].alias("p"), x["v"].alias("v")))
    two = F.slice(F.array_sort(near), 1, 2)
    mean = F.try_divide(F.aggregate(two, F.lit(0.0), lambda s, x: s + x["v"]), F.size(two))
    return rows.withColumn("_m", F.bround(mean, 0)).where("_want = 1").select(*keys, at, F.col("_m").alias(value))
