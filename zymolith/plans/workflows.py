"""End-to-end plans: prepare a table, train and score folds, evaluate, tune, screen."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import canonical as canonical_texts
from ..functions.chemistry import without_stereo_marks
from ..functions.fixed_values import MULTI_MOLECULE, SUBSTRATES
from ..operators import cleaning as C
from ..operators import folds as D
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import relations as R
from ..operators.learning import OneVsRest, bayesian_search
from ..operators.multi_output import NewtonBoosting, SharedForest, SigmoidNetwork
from ..sources.text_formats import read_fasta
from ..streaming.screening import Scorer, hits, scored

NOT_EVALUATED = (L.UNKNOWN, L.OTHER)
#: Learners of all labels in one model.
SHARED = {"shared_forest": SharedForest, "newton_boosting": NewtonBoosting, "sigmoid_network": SigmoidNetwork}


def prepared(reactions: DataFrame, negatives: DataFrame | None = None, blacklist: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """The reaction table, cleaned: one row an enzyme, substrate and product.

    Takes columns id, sequence, type, substrate_name, product, fragment,
    product_is_major_raw and kingdom_raw.  Substrate names become structures, those
    without one go; products that are no structure are ``Unknown``; two-molecule
    substrates are set; unbalanced rows, rows without a sequence and fragments go.
    ``canonical``: (text, canonical) of structures; without it stereo marks are cut
    from the text.  ``blacklist``: (id).  ``negatives``: (id, sequence); those with
    residues that are no standard ones go.
    """
    rows = reactions.withColumns({"id": C.trimmed_id(F.col("id")), "sequence": C.squeezed(F.col("sequence"))})
    if blacklist is not None:
        rows = C.not_in(rows, "id", blacklist, "id")
    name = F.when(F.col("type") == L.NEGATIVE, L.NEGATIVE).otherwise(F.col("substrate_name"))
    rows = rows.withColumn("substrate", C.mapped(name, SUBSTRATES | {L.NEGATIVE: L.NEGATIVE})).where(C.present_or(F.col("substrate"), F.col("type")))
    rows = rows.withColumn("product", F.when(C.can_be_canonical(F.col("product")), F.col("product")).otherwise(L.UNKNOWN))
    for column in ("substrate", "product"):
        if canonical is None:
            rows = rows.withColumn(column, without_stereo_marks(F.col(column)))
        else:
            rows = canonical_texts(rows, column, f"_{column}", canonical).drop(column).withColumnRenamed(f"_{column}", column)
    fixes = [((F.col("type") == t) & (F.col("substrate") == old), new) for t, old, new in MULTI_MOLECULE]
    rows = rows.withColumn("substrate", C.conditional_fixes(F.col("substrate"), fixes))
    rows = rows.where(C.carbon_balanced(F.col("product"), F.col("substrate")) & F.col("sequence").isNotNull())
    rows = rows.where(C.complete(F.col("sequence"), F.col("substrate"), F.col("fragment"))).withColumn("kingdom", C.kingdom(F.col("kingdom_raw")))
    products = L.nonnull_counts(rows, ["id", "substrate"], "product").withColumnRenamed("n", "_products")
    rows = rows.join(products, ["id", "substrate"]).withColumn("product_is_major", C.major_product(F.col("_products"), F.col("product_is_major_raw")))
    out = rows.select("id", "sequence", "type", L.precursor_rewrite(F.col("type"), F.col("substrate")).alias("substrate"), "product", "kingdom", "product_is_major")
    if negatives is None:
        return out
    clean = negatives.where(C.standard_residues(F.col("sequence"))).join(out.select("id").distinct(), "id", "left_anti")
    blank = {c: F.lit(None).cast("string") for c in ("product", "kingdom")}
    extra = clean.select("id", C.squeezed(F.col("sequence")).alias("sequence")).withColumns({"type": F.lit(L.NEGATIVE), "substrate": F.lit(L.UNKNOWN), **blank, "product_is_major": F.lit(False)})
    return out.unionByName(extra)


def examples(table: DataFrame, id_col: str = "id", target: str = "substrate") -> DataFrame:
    """(id, labels) with the detection label; negatives have only ``Unknown``."""
    sets = L.label_sets(table, id_col, target)
    return sets.select(F.col(id_col).alias("id"), L.augmented(F.col("labels")).alias("labels"))


def with_folds(table: DataFrame, clades: DataFrame, folds: int = 5, seeds: int = 100) -> DataFrame:
    """Adds ``fold``: groups (clades, else ids) are never parted; rows of negatives are dealt evenly."""
    positive = table.where(F.col("type") != L.NEGATIVE)
    majors = positive.where("product_is_major").select("id")
    grouped = D.group_ids(positive.select("id", F.col("substrate").alias("label")).distinct(), clades, majors)
    place = D.group_kfold(D.group_counts(grouped), folds, seeds)
    by_id = grouped.select("id", "group").distinct().join(place, "group").select("id", "fold")
    rest = table.where(F.col("type") == L.NEGATIVE).select("id").distinct()
    dealt = D.stratified_kfold(rest, folds, "id", F.lit("negative"))
    out = table.join(by_id.unionByName(dealt.select("id", "fold")), "id")
    return out


def test_rows(table: DataFrame, fold, holdout: DataFrame | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """Rows to score: those of the fold, or a hold-out set with its own negatives."""
    if holdout is None:
        return table.where(F.col("fold") == fold)
    return holdout if negatives is None else holdout.unionByName(negatives, allowMissingColumns=True)


def train_and_score(rows: DataFrame, classes: Sequence[str], learner: str, params: Mapping[str, object], name: str, folds: Sequence[int], class_params: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """(model, fold, id, class, score, label) for rows (id, features, labels, fold): each fold by a model of the others.

    ``learner`` is one of ``learning.LEARNERS``, a model a class, or of SHARED, one model for all.
    """
    out = None
    for fold in folds:
        train, test = R.other_folds(rows, fold), rows.where(F.col("fold") == fold)
        R.assert_disjoint(train, test, ["id"])
        model = SHARED[learner](**params) if learner in SHARED else OneVsRest(learner, params, class_params or {}, balanced=True)
        model = model.fit(train.select("id", "features", "labels"), classes)
        got = model.predict(test, classes).join(test.select("id", "labels"), "id")
        got = got.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "id", "class", "score", F.array_contains("labels", F.col("class")).cast("int").alias("label"))
        out = got if out is None else out.unionByName(got)
    return out


def fold_scores(predictions: DataFrame, categories: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(model, fold, class, ap, auc, mccf1) of classes with enough positives; by category if one is given for ids."""
    rows = predictions.where(~F.col("class").isin(*NOT_EVALUATED))
    if categories is None:
        return M.scores_by_group(rows, ["model", "fold", "class"], least)
    rows = rows.join(categories.select("id", "category"), "id", "left").withColumn("category", F.coalesce("category", F.lit(L.UNKNOWN)))
    return M.scores_by_category(rows, ["model", "fold"], least).withColumnRenamed("name", "class")


def evaluated(scores: DataFrame, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(per class, summary): mean and deviation of each class, and macro mean with pooled error of each model.

    Both are long in the metric: a row a model (and class) and metric.
    """
    long = scores.unpivot(["model", "fold", "class"], ["ap", "auc", "mccf1"], "metric", "value")
    per_class = M.mean_and_sd(long, ["model", "class", "metric"], folds)
    summary = M.pooled_error(long, ["model", "metric"])
    return per_class, summary.select("model", "metric", "mean", (F.col("mean") - F.col("error")).alias("lower"), (F.col("mean") + F.col("error")).alias("upper"))


def tuned(rows: DataFrame, classes: Sequence[str], learner: str, space: Mapping[str, Sequence], trials: int, start: dict | None = None, inner: int = 3, seed: int = 42) -> tuple[dict, float]:
    """The parameters with the greatest mean average precision over inner folds (id hash), negatives aside."""
    held = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(inner)).cast("int")).cache()

    def loss(params: dict) -> float:
        preds = train_and_score(held, classes, learner, params, "trial", range(inner))
        ap = M.average_precision(M.counts_curve(M.eligible(preds, ["fold", "class"], 2), ["fold", "class"]), ["fold", "class"])
        value = M.negative_mean_ap(ap, [], L.UNKNOWN).first()["loss"]
        return 1.0 if value is None else value

    try:
        return bayesian_search(space, trials, loss, start, seed)
    finally:
        held.unpersist()


def screened(spark: SparkSession, fasta: str, load: Callable[[], Scorer], classes: Sequence[str], models: int, threshold: float, first: int = 0, last: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Hits among the records [first, last) of a sequence file that are not ``done`` yet."""
    records = read_fasta(spark, fasta).where(C.standard_residues(F.col("sequence")))
    records = R.ordinal_range(records, "ordinal", first, last if last is not None else 1 << 62)
    if done is not None:
        records = R.unprocessed(records, done, ["id"])
    return hits(scored(records, load, classes), models, classes, threshold)
