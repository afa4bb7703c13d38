"""Label sets: building, counting, rewriting and encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sides import small_side

# Label names with a meaning of their own.
DETECTED, UNKNOWN, NEGATIVE, OTHER, PRECURSOR = "isTPS", "Unknown", "Negative", "other", "precursor substr"
PRECURSOR_TYPES = ("ggpps", "fpps", "gpps", "gfpps", "hsqs")


def label_sets(facts: DataFrame, key: str, target: str, null_label: str | None = None) -> DataFrame:
    """(key, labels): sorted distinct targets; null keys are dropped, null targets too unless named."""
    value = F.col(target) if null_label is None else F.coalesce(F.col(target), F.lit(null_label))
    return facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("labels"))


def set_counts(sets: DataFrame, least: int = 10) -> DataFrame:
    """(labels, n, label): label sets that occur at least ``least`` times, a row a member."""
    counts = sets.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.select("labels", "n", F.explode("labels").alias("label"))


def augmented(labels: Column, extra: str = DETECTED, unless: Sequence[str] = (UNKNOWN, PRECURSOR)) -> Column:
    """The set with ``extra``, unless it has one of ``unless``."""
    return F.when(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in unless])), labels).otherwise(F.array_sort(F.array_union(labels, F.array(F.lit(extra)))))


def stratum(labels: Column) -> Column:
    """A label set as one string."""
    return F.array_join(F.array_sort(labels), ",")


def precursor_rewrite(kind: Column, target: Column, kinds: Sequence[str] = PRECURSOR_TYPES) -> Column:
    """Targets of the given types become one label."""
    return F.when(kind.isin(*kinds), F.lit(PRECURSOR)).otherwise(target)


def ignored_rewrite(ignored: Column, target: Column) -> Column:
    return F.when(F.coalesce(ignored, F.lit(False)), F.lit(OTHER)).otherwise(target)


def major_class_distribution(sets: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, share): only sets of one member are counted; absent classes have 0."""
    by = list(by)
    single = sets.where(F.size("labels") == 1).select(*by, F.col("labels")[0].alias("class")).join(small_side(classes), "class", "left_semi")
    counts = single.groupBy(*by, "class").agg(F.count(F.lit(1)).alias("n"))
    frame = (sets.select(*by).distinct().crossJoin(small_side(classes)) if by else classes).join(counts, [*by, "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = frame.groupBy(*by).agg(F.sum("n").alias("total"))
    frame = frame.join(totals, by) if by else frame.crossJoin(F.broadcast(totals))
    return frame.select(*by, "class", F.try_divide("n", "total").alias("share"))


def cooccurrence(rows: DataFrame, group: str, target: str, id_col: str) -> DataFrame:
    """(group, target, n): distinct ids."""
    return rows.groupBy(group, target).agg(F.countDistinct(id_col).alias("n"))


def unsplittable(rows: DataFrame, group: str, target: str, id_col: str, folds: int, share: float = 0.5) -> DataFrame:
    """Targets of which one group has more than ``share``, or that have fewer rows than folds.

    The share divides ids by rows: the two counts are meant to differ.
    """
    totals = rows.groupBy(target).agg(F.count(F.lit(1)).alias("total"))
    most = cooccurrence(rows, group, target, id_col).groupBy(target).agg(F.max("n").alias("most"))
    out = totals.join(most, target)
    return out.where((F.col("most") / F.col("total") > share) | (F.col("total") < folds)).select(target)


def nonnull_counts(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(column).alias("n"))


def single_valued(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys with exactly one distinct value that is not null."""
    return rows.groupBy(*keys).agg(F.countDistinct(column).alias("n")).where("n = 1").select(*keys)


def one_hot(labels: Column, classes: Sequence[str]) -> list[Column]:
    """A 0/1 column a class; labels outside ``classes`` are dropped."""
    return [F.array_contains(labels, c).cast("int").alias(c) for c in classes]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
