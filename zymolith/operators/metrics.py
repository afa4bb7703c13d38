"""Ranking metrics over long predictions (keys..., score, label) with label 0 or 1.

Everything starts from the curve: one row per (keys, distinct score) with running
counts from the greatest score down.  Scores are aggregated before anything is
ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import at_least_one, running_sums
from ..functions.scratch import written
from .blocks import label_sums, packed

NAN = float("nan")


def points_of(preds: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, threshold, n, pos): rows and positives at each distinct score."""
    return preds.groupBy(*keys, F.col(score).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def counts_curve(preds: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, threshold, n, pos, pp, tp, P, T): counts at each distinct score, running and in total."""
    return curve_of(points_of(preds, keys, score, label), keys)


def curve_of(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("n").alias("T"))
    return running_sums(points, keys, "threshold", {"pp": "n", "tp": "pos"}).join(totals, keys)


def eligible(preds: DataFrame, keys: Sequence[str], least: int = 3, label: str = "label") -> DataFrame:
    """Rows of groups with at least ``least`` positives and one negative."""
    groups = preds.groupBy(*keys).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("t")).where((F.col("p") >= least) & (F.col("p") < F.col("t")))
    return preds.join(groups.select(*keys), list(keys), "left_semi")


def require_both_classes(preds: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """``preds``, or an error when read if a group has no positive or no negative."""
    groups = preds.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.col(label).cast("int")).alias("_p"), F.min(F.col(label).cast("int")).alias("_q"))
    ok = F.when(F.col("_p") == 0, F.raise_error(F.lit("no positive samples"))).when(F.col("_q") == 1, F.raise_error(F.lit("no negative samples"))).otherwise(F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return preds.join(groups.withColumn("_ok", ok.cast("boolean")).where("_ok"), same, "left_semi")


def mcc_f1_curve(preds: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", unit: bool = True) -> DataFrame:
    """(keys, threshold, mcc, f1) at each distinct score; mcc is scaled to [0, 1] if ``unit``."""
    c = counts_curve(preds, keys, score, label)
    p, t, pp, tp = (F.col(x).cast("double") for x in ("P", "T", "pp", "tp"))
    n = t - p
    mcc = (n * tp - p * (pp - tp)) / at_least_one(F.sqrt(p * n * pp * (t - pp)))
    return c.select(*keys, "threshold", ((mcc + 1) / 2 if unit else mcc).alias("mcc"), (2 * tp / (pp + p)).alias("f1"))


def mcc_f1_summary(curve: DataFrame, keys: Sequence[str], bins: int = 100) -> DataFrame:
    """(keys, mccf1): one minus the mean over bins of the distance to (1, 1), over sqrt 2.

    The curve is cut after the first greatest mcc (in order of falling threshold).
    On either side bin i holds the points with mcc in the closed interval
    [low + (i - 1) * unit, low + i * unit]; points on an edge count in both bins,
    and the slice above the last bin in none.  A point has at most four candidate
    bins, each checked exactly, so the range join never compares all bins.
    """
    keys = list(keys)
    stats = curve.groupBy(*keys).agg(F.min("mcc").alias("low"), F.max("mcc").alias("high"), F.max(F.struct(F.col("mcc"), F.col("threshold"))).getField("threshold").alias("top"))
    rows = curve.join(stats, keys).withColumn("unit", (F.col("high") - F.col("low")) / F.lit(bins))
    side = (F.col("threshold") < F.col("top")).cast("int")
    distance = F.sqrt((F.col("mcc") - 1) * (F.col("mcc") - 1) + (F.col("f1") - 1) * (F.col("f1") - 1))
    near = F.when(F.col("unit") > 0, F.floor((F.col("mcc") - F.col("low")) / F.when(F.col("unit") > 0, F.col("unit")))).otherwise(F.lit(0)).cast("int")
    candidates = F.when(F.col("unit") > 0, F.sequence(F.greatest(F.lit(0), near - 1), F.least(F.lit(bins - 1), near + 2))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))
    candidates = F.when(near - 1 <= bins - 1, candidates).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*keys, side.alias("side"), distance.alias("distance"), "mcc", "low", "unit", F.explode(candidates).alias("bin"))
    inside = (F.col("mcc") >= F.col("low") + (F.col("bin") - 1) * F.col("unit")) & (F.col("mcc") <= F.col("low") + F.col("bin") * F.col("unit"))
    means = rows.where(inside).groupBy(*keys, "side", "bin").agg(F.avg("distance").alias("d"))
    return means.groupBy(*keys).agg((1 - F.avg("d") / F.sqrt(F.lit(2.0))).alias("mccf1"))


def best_threshold(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, best_threshold): the first point, from the greatest threshold down, nearest to (1, 1)."""
    d = F.sqrt((1 - F.col("mcc")) * (1 - F.col("mcc")) + (1 - F.col("f1")) * (1 - F.col("f1")))
    return curve.groupBy(*keys).agg(F.min_by("threshold", F.struct(d, -F.col("threshold"))).alias("best_threshold"))


def average_precision(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ap): the sum of precision times the step in recall, over distinct scores."""
    return counts.groupBy(*keys).agg(_ap())


def _ap() -> Column:
    return F.sum(F.col("pos") * F.col("tp") / F.col("pp") / F.col("P")).alias("ap")


def _auc() -> Column:
    neg = F.col("n") - F.col("pos")
    above = F.col("tp") - F.col("pos")
    pairs = F.sum(neg.cast("double") * above + 0.5 * neg * F.col("pos"))
    return (pairs / (F.first("P").cast("double") * (F.first("T") - F.first("P")))).alias("auc")


def roc_auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, auc): the share of (positive, negative) pairs in order; ties count one half."""
    return counts.groupBy(*keys).agg(_auc())


def pr_curve(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, threshold, precision, recall), and a last point (null, 1, 0)."""
    points = counts.select(*keys, F.col("threshold").cast("double").alias("threshold"), (F.col("tp") / F.col("pp")).alias("precision"), (F.col("tp") / F.col("P")).alias("recall"))
    ends = counts.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(ends)


def pr_grid(counts: DataFrame, keys: Sequence[str], steps: int = 100) -> DataFrame:
    """(keys, recall, precision) on a grid of recalls, linear between the curve's points.

    The curve starts at recall 0 with the precision of its greatest threshold; at
    recalls with several points the last one holds.  Each point carries the next
    point and fills the grid recalls in [its recall, the next recall).
    """
    keys = list(keys)
    points = counts.select(*keys, "threshold", (F.col("tp") / F.col("pp")).alias("p"), (F.col("tp") / F.col("P")).alias("r"))
    by_recall = points.groupBy(*keys, "r").agg(F.max_by("p", "threshold").alias("enter"), F.min_by("p", "threshold").alias("leave"))
    at_zero = F.min_by("p", F.when(F.col("r") == 0, F.col("threshold")))
    first = points.groupBy(*keys).agg(F.max_by("p", "threshold").alias("enter"), at_zero.alias("leave"))
    first = first.withColumns({"leave": F.coalesce("leave", "enter"), "r": F.lit(0.0)})
    by_recall = by_recall.where("r > 0").unionByName(first.select(*by_recall.columns))
    w = Window.partitionBy(*keys).orderBy("r")
    spans = by_recall.withColumns({"r2": F.lead("r").over(w), "p2": F.lead("enter").over(w)})
    low, high = F.ceil(F.col("r") * steps - 1e-9), F.when(F.col("r2").isNull(), F.lit(steps)).otherwise(F.ceil(F.col("r2") * steps - 1e-9) - 1)
    cells = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    grid = spans.select("*", F.explode(cells).alias("cell")).withColumn("recall", F.col("cell") / F.lit(float(steps)))
    slope = (F.col("p2") - F.col("leave")) * (F.col("recall") - F.col("r")) / (F.col("r2") - F.col("r"))
    return grid.select(*keys, "recall", F.when(F.col("r2").isNull(), F.col("leave")).otherwise(F.col("leave") + slope).alias("precision"))


def mean_pr_curve(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, recall, mean, lower, upper): mean over folds and classes, one population deviation either way, at most 1."""
    out = grid.groupBy(*keys, "recall").agg(F.avg("precision").alias("mean"), F.stddev_pop("precision").alias("sd"))
    return out.select(*keys, "recall", "mean", (F.col("mean") - F.col("sd")).alias("lower"), F.least(F.col("mean") + F.col("sd"), F.lit(1.0)).alias("upper"))


def with_shared_negatives(preds: DataFrame, category: str = "category", unknown: str = "Unknown", class_col: str = "class") -> DataFrame:
    """Rows of category ``unknown`` are added to every other category; adds ``name`` = category_|_class.

    The categories present are few; each unknown row is exploded over their list.
    Give it the points of many predictions (``points_of``), not the predictions.
    """
    known = preds.where(F.col(category) != unknown)
    listed = known.agg(F.array_sort(F.collect_set(category)).alias("_all"))
    shared = preds.where(F.col(category) == unknown).crossJoin(F.broadcast(listed)).withColumn(category, F.explode("_all")).drop("_all")
    both = known.unionByName(shared.select(*known.columns))
    name = F.when(F.col(category) == "", F.col(class_col)).otherwise(F.concat_ws("_|_", category, class_col))
    return both.withColumn("name", name)


def scores_by_group(preds: DataFrame, keys: Sequence[str], least: int = 3, bins: int = 100) -> DataFrame:
    """(keys, ap, auc, mccf1) of the groups with enough positives: the flagship plan, one curve for all metrics."""
    return scores_of(points_of(preds, keys), keys, least, bins)


def scores_by_category(preds: DataFrame, keys: Sequence[str], least: int = 3, bins: int = 100, category: str = "category", unknown: str = "Unknown", class_col: str = "class") -> DataFrame:
    """(name, keys, ap, auc, mccf1) for each name = category_|_class, with the rows of category ``unknown`` in every other one.

    Predictions are counted by score before the unknown ones are added, so a
    category costs the distinct scores of unknown rows, not the rows.
    """
    points = with_shared_negatives(points_of(preds, [category, class_col, *keys]), category, unknown, class_col)
    points = points.groupBy("name", *keys, "threshold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return scores_of(points, ["name", *keys], least, bins)


def scores_of(points: DataFrame, keys: Sequence[str], least: int = 3, bins: int = 100) -> DataFrame:
    """The same for counted predictions, one row a threshold."""
    keys = list(keys)
    # the curve is read three times: written, it is made once
    counts = written(curve_of(points, keys).where((F.col("P") >= least) & (F.col("P") < F.col("T"))), "curve")
    p, t, pp, tp = (F.col(x).cast("double") for x in ("P", "T", "pp", "tp"))
    mcc = ((t - p) * tp - p * (pp - tp)) / at_least_one(F.sqrt(p * (t - p) * pp * (t - pp)))
    curve = counts.select(*keys, "threshold", ((mcc + 1) / 2).alias("mcc"), (2 * tp / (pp + p)).alias("f1"))
    return counts.groupBy(*keys).agg(_ap(), _auc()).join(mcc_f1_summary(curve, keys, bins), keys)


def mean_and_sd(values: DataFrame, keys: Sequence[str], folds: int, value: str = "value") -> DataFrame:
    """(keys, mean, sd): mean over the folds that are there; sample deviation, NaN unless all ``folds`` are."""
    return values.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.when((F.count(value) == folds) & (F.count(value) > 1), F.stddev_samp(value)).otherwise(F.lit(NAN)).alias("sd"),
    )


def pooled_error(values: DataFrame, keys: Sequence[str], class_col: str = "class", value: str = "value") -> DataFrame:
    """(keys, mean, error): mean of class means; sqrt of the sum of class variances over the number of classes.

    A class with one fold has no variance: the error is NaN, not smaller.
    """
    per_class = values.groupBy(*keys, class_col).agg(F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(NAN)).alias("v"))
    return per_class.groupBy(*keys).agg(F.avg("m").alias("mean"), (F.sqrt(F.sum("v")) / F.count(F.lit(1))).alias("error"))


def pooled_by_type(class_scores: DataFrame, type_col: str = "type", mean: str = "mean", sd: str = "sd") -> DataFrame:
    """(type, mean, error): sum of means over n, sqrt of the sum of squared deviations over n."""
    return class_scores.groupBy(type_col).agg(F.avg(mean).alias("mean"), (F.sqrt(F.sum(F.col(sd) * F.col(sd))) / F.count(F.lit(1))).alias("error"))


def negative_mean_ap(ap: DataFrame, keys: Sequence[str], negative: str = "Unknown", class_col: str = "class") -> DataFrame:
    """(keys, loss): one minus the mean average precision of all classes but the negative one."""
    return ap.where(F.col(class_col) != negative).groupBy(*keys).agg((1 - F.avg("ap")).alias("loss"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Summand of the squared Jensen-Shannon distance for one outcome; sum it and take the root."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def js_distance(dist: DataFrame, other: DataFrame, keys: Sequence[str], outcome: str, weight: str = "weight") -> DataFrame:
    """(keys, js): distance between the normalised distributions of ``dist`` and ``other`` over ``outcome`` by ``keys``."""
    keys = list(keys)
    norm = lambda d, name: d.select(*keys, outcome, (F.col(weight) / F.sum(weight).over(Window.partitionBy(*keys))).alias(name))
    both = norm(dist, "p").join(norm(other, "q"), [*keys, outcome], "full")
    part = jensen_shannon(F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0)))
    return both.groupBy(*keys).agg(F.sqrt(F.greatest(F.sum(part), F.lit(0.0))).alias("js"))


def silhouette(distances: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) from mirrored distances (i, j, d), i <> j, and (id, cluster).

    Mean distance by (point, cluster) first, so only points times clusters rows are
    compared; a point alone in its cluster has 0.
    """
    to = clusters.select(F.col("id").alias("j"), F.col("cluster").alias("other"))
    means = distances.join(to, "j").groupBy("i", "other").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("c"))
    return _silhouette(means, clusters)


def silhouette_of_vectors(vectors: DataFrame) -> DataFrame:
    """The same by Euclidean distance of (id, embedding, cluster): sums over pairs of packs instead of a list of pairs."""
    means = label_sums(packed(vectors, rest=["cluster"]), "cluster")
    return _silhouette(means, vectors.select("id", "cluster"))


def _silhouette(means: DataFrame, clusters: DataFrame) -> DataFrame:
    """``silhouette`` from (i, other, s, c): sum and number of distances to each cluster."""
    sizes = clusters.groupBy("cluster").count()
    rows = clusters.withColumnRenamed("id", "i").join(means, "i", "left")
    a = F.max(F.when(F.col("cluster") == F.col("other"), F.col("s") / F.col("c")))
    b = F.min(F.when(F.col("cluster") != F.col("other"), F.col("s") / F.col("c")))
    out = rows.groupBy("i", "cluster").agg(a.alias("a"), b.alias("b")).join(sizes, "cluster")
    value = F.when(F.col("count") == 1, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return out.select(F.col("i").alias("id"), "cluster", value.alias("silhouette"))
