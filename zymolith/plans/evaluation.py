"""Evaluation queries: labels of documents as classes, text length as score, id mod 5 as fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query, rounded, table

KEYS = ["class", "fold"]

_PRED = """
pred AS (
  SELECT d.lang AS category, c.class, CAST(d.doc_id % 5 AS BIGINT) AS fold, d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score,
         CAST(CASE WHEN c.class = 'quality' THEN l.quality ELSE l.toxic END AS BIGINT) AS label
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id CROSS JOIN (VALUES ('quality'), ('toxic')) c(class))"""
_COUNTS = """
points AS (SELECT class, fold, score AS threshold, count(*) AS n, sum(label) AS pos FROM {src} GROUP BY ALL),
cc AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS pp, CAST(sum(pos) OVER w AS DOUBLE) AS tp,
              CAST(sum(pos) OVER g AS DOUBLE) AS pt, CAST(sum(n) OVER g AS DOUBLE) AS nt
       FROM points WINDOW w AS (PARTITION BY class, fold ORDER BY threshold DESC), g AS (PARTITION BY class, fold))"""
_CURVE = """
curve AS (SELECT class, fold, threshold,
    (((nt - pt) * tp - pt * (pp - tp)) / CASE WHEN sqrt(pt * (nt - pt) * pp * (nt - pp)) = 0 THEN 1 ELSE sqrt(pt * (nt - pt) * pp * (nt - pp)) END + 1) / 2 AS mcc,
    2 * tp / (pp + pt) AS f1
  FROM cc WHERE pt >= {least} AND pt < nt)"""
_SUMMARY = """
stats AS (SELECT class, fold, min(mcc) AS low, (max(mcc) - min(mcc)) / 100 AS unit, max(mcc) AS high FROM curve GROUP BY ALL),
tops AS (SELECT c.class, c.fold, max(c.threshold) AS top FROM curve c JOIN stats s USING (class, fold) WHERE c.mcc = s.high GROUP BY ALL),
cells AS (SELECT class, fold, c.threshold < t.top AS side, b.i AS i, avg(sqrt((mcc - 1) * (mcc - 1) + (f1 - 1) * (f1 - 1))) AS d
  FROM curve c JOIN stats s USING (class, fold) JOIN tops t USING (class, fold) CROSS JOIN range(100) b(i)
  WHERE mcc >= low + (i - 1) * unit AND mcc <= low + i * unit GROUP BY ALL),
summary AS (SELECT class, fold, 1 - avg(d) / sqrt(2) AS mccf1 FROM cells GROUP BY ALL)"""


def _sql(*ctes: str, tail: str, least: int = 1, src: str = "pred") -> str:
    return "WITH " + ",".join(ctes).format(src=src, least=least) + tail


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, class, fold, id, score, label)."""
    labels = table(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "class", "label")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    both = labels.join(docs, "doc_id")
    return both.select(F.col("lang").alias("category"), "class", (F.col("doc_id") % 5).alias("fold"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("label").cast("long").alias("label"))


def _counts(spark, sf_dir) -> DataFrame:
    return M.counts_curve(M.eligible(predictions(spark, sf_dir), KEYS, 1), KEYS)


@query("m1_mcc_f1_curve", _sql(_PRED, _COUNTS, _CURVE, tail=" SELECT class, fold, threshold, round(mcc, 6) AS mcc, round(f1, 6) AS f1 FROM curve"))
def mcc_f1_curve(spark, sf_dir):
    return rounded(M.mcc_f1_curve(M.eligible(predictions(spark, sf_dir), KEYS, 1), KEYS), "mcc", "f1")


@query("m2_mcc_f1_summary", _sql(_PRED, _COUNTS, _CURVE, _SUMMARY, tail=" SELECT class, fold, round(mccf1, 6) AS mccf1 FROM summary"))
def mcc_f1_summary(spark, sf_dir):
    curve = M.mcc_f1_curve(M.eligible(predictions(spark, sf_dir), KEYS, 1), KEYS)
    return rounded(M.mcc_f1_summary(curve, KEYS), "mccf1")


@query("m3_best_threshold", _sql(_PRED, _COUNTS, _CURVE, tail=" SELECT class, fold, first(threshold ORDER BY sqrt((1 - mcc) * (1 - mcc) + (1 - f1) * (1 - f1)), threshold DESC) AS best_threshold FROM curve GROUP BY ALL"))
def best_threshold(spark, sf_dir):
    return M.best_threshold(M.mcc_f1_curve(M.eligible(predictions(spark, sf_dir), KEYS, 1), KEYS), KEYS)


@query("m4_average_precision", _sql(_PRED, _COUNTS, tail=" SELECT class, fold, round(sum(pos * tp / pp / pt), 6) AS ap FROM cc WHERE pt >= 1 AND pt < nt GROUP BY ALL"))
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(_counts(spark, sf_dir), KEYS), "ap")


@query(
    "m5_roc_auc",
    f"""WITH {_PRED} SELECT a.class, a.fold, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc
    FROM pred a JOIN pred b ON a.class = b.class AND a.fold = b.fold AND a.label = 1 AND b.label = 0 GROUP BY ALL""",
)
def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(_counts(spark, sf_dir), KEYS), "auc")


@query(
    "m6_pr_curve",
    _sql(_PRED, _COUNTS, tail=""" SELECT class, fold, threshold, round(tp / pp, 6) AS precision, round(tp / pt, 6) AS recall FROM cc WHERE pt >= 1 AND pt < nt
    UNION ALL SELECT DISTINCT class, fold, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM cc WHERE pt >= 1 AND pt < nt"""),
)
def pr_curve(spark, sf_dir):
    return rounded(M.pr_curve(_counts(spark, sf_dir), KEYS), "precision", "recall")


_GRID = """
pr AS (SELECT class, fold, threshold, tp / pp AS p, tp / pt AS r FROM cc WHERE pt >= 1 AND pt < nt),
steps AS (SELECT class, fold, r, first(p ORDER BY threshold DESC) AS enter, first(p ORDER BY threshold) AS leave FROM pr GROUP BY ALL),
tops AS (SELECT class, fold, first(p ORDER BY threshold DESC) AS p1 FROM pr GROUP BY ALL),
knots AS (SELECT class, fold, r, enter, leave FROM steps
  UNION ALL SELECT class, fold, 0, p1, p1 FROM tops t WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.class = t.class AND s.fold = t.fold AND s.r = 0)),
spans AS (SELECT *, lead(r) OVER w AS r2, lead(enter) OVER w AS p2 FROM knots WINDOW w AS (PARTITION BY class, fold ORDER BY r)),
grid AS (SELECT class, fold, g.i / 100.0::DOUBLE AS recall, CASE WHEN r2 IS NULL THEN leave ELSE leave + (p2 - leave) * (g.i / 100.0::DOUBLE - r) / (r2 - r) END AS precision
  FROM spans JOIN range(101) g(i) ON g.i / 100.0::DOUBLE >= r - 1e-11 AND (r2 IS NULL OR g.i / 100.0::DOUBLE < r2 - 1e-11))"""


@query("m7_mean_pr_curve", _sql(_PRED, _COUNTS, _GRID, tail=" SELECT class, recall, round(avg(precision), 6) AS mean, round(avg(precision) - stddev_pop(precision), 6) AS lower, round(least(avg(precision) + stddev_pop(precision), 1), 6) AS upper FROM grid GROUP BY class, recall"))
def mean_pr_curve(spark, sf_dir):
    return rounded(M.mean_pr_curve(M.pr_grid(_counts(spark, sf_dir), KEYS), ["class"]), "mean", "lower", "upper")


@query("m8_eligible_groups", f"WITH {_PRED} SELECT class, fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS positives FROM pred GROUP BY ALL HAVING sum(label) >= 3 AND sum(label) < count(*)")
def eligible_groups(spark, sf_dir):
    return M.eligible(predictions(spark, sf_dir), KEYS, 3).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


_AP = "ap AS (SELECT class, fold, sum(pos * tp / pp / pt) AS ap FROM cc WHERE pt >= 1 AND pt < nt GROUP BY ALL)"


@query("m9_negative_mean_ap", _sql(_PRED, _COUNTS, _AP, tail=" SELECT fold, round(1 - avg(ap), 6) AS loss FROM ap WHERE class <> 'toxic' GROUP BY fold"))
def negative_mean_ap(spark, sf_dir):
    return rounded(M.negative_mean_ap(M.average_precision(_counts(spark, sf_dir), KEYS), ["fold"], negative="toxic"), "loss")


_SHARED = """
shared AS (SELECT category || '_|_' || class AS class, fold, score, label FROM pred WHERE category <> 'es'
  UNION ALL SELECT k.category || '_|_' || class, fold, score, label FROM pred CROSS JOIN (SELECT DISTINCT category FROM pred WHERE category <> 'es') k WHERE pred.category = 'es')"""


@query(
    "a9_metrics_by_category",
    _sql(_PRED, _SHARED, _COUNTS, _CURVE, _SUMMARY, src="shared", least=3, tail="""
    SELECT class AS name, fold, round(ap, 6) AS ap, round(mccf1, 6) AS mccf1 FROM summary JOIN (SELECT class, fold, sum(pos * tp / pp / pt) AS ap FROM cc WHERE pt >= 3 AND pt < nt GROUP BY ALL) USING (class, fold)"""),
)
def metrics_by_category(spark, sf_dir):
    return rounded(M.scores_by_category(predictions(spark, sf_dir), ["fold"], 3, unknown="es").drop("auc"), "ap", "mccf1")


def _fold_values(spark, sf_dir) -> DataFrame:
    return M.average_precision(_counts(spark, sf_dir), KEYS).withColumnRenamed("ap", "value")


def _nan(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 'nan' ELSE CAST(round({x}, 6) AS VARCHAR) END"


@query("a10_mean_and_sd", _sql(_PRED, _COUNTS, _AP, tail=" SELECT class, round(avg(ap), 6) AS mean, round(CASE WHEN count(*) = 5 THEN stddev_samp(ap) ELSE -1 END, 6) AS sd FROM ap GROUP BY class"))
def mean_and_sd(spark, sf_dir):
    out = M.mean_and_sd(_fold_values(spark, sf_dir), ["class"], folds=5)
    return rounded(out.withColumn("sd", F.when(F.isnan("sd"), F.lit(-1.0)).otherwise(F.col("sd"))), "mean", "sd")


@query("a11_pooled_error", _sql(_PRED, _COUNTS, _AP, tail=""" SELECT round(avg(m), 6) AS mean, round(CASE WHEN min(k) < 2 THEN -1 ELSE sqrt(sum(v)) / count(*) END, 6) AS error
    FROM (SELECT class, avg(ap) AS m, var_samp(ap) AS v, count(*) AS k FROM ap GROUP BY class)"""))
def pooled_error(spark, sf_dir):
    out = M.pooled_error(_fold_values(spark, sf_dir), [])
    return rounded(out.withColumn("error", F.when(F.isnan("error"), F.lit(-1.0)).otherwise(F.col("error"))), "mean", "error")


@query("a12_pooled_by_type", _sql(_PRED, _COUNTS, _AP, tail=""" SELECT CAST(fold % 2 AS BIGINT) AS type, round(avg(ap), 6) AS mean, round(sqrt(sum(ap * ap)) / count(*), 6) AS error FROM ap GROUP BY fold % 2"""))
def pooled_by_type(spark, sf_dir):
    rows = _fold_values(spark, sf_dir).select((F.col("fold") % 2).alias("type"), F.col("value").alias("mean"), F.col("value").alias("sd"))
    return rounded(M.pooled_by_type(rows), "mean", "error")


@query(
    "m10_js_distance",
    f"""WITH {_PRED}, p AS (SELECT fold, class, count(*) FILTER (label = 1) * 1.0::DOUBLE / sum(count(*) FILTER (label = 1)) OVER (PARTITION BY fold) AS p FROM pred GROUP BY fold, class),
    q AS (SELECT class, count(*) FILTER (label = 1) * 1.0::DOUBLE / sum(count(*) FILTER (label = 1)) OVER () AS q FROM pred GROUP BY class)
    SELECT fold, round(sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2))), 6) AS js
    FROM p JOIN q USING (class) GROUP BY fold""",
)
def js_distance(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    mine = preds.groupBy("fold", "class").agg(F.sum("label").alias("weight"))
    whole = mine.groupBy("class").agg(F.sum("weight").alias("weight")).crossJoin(F.broadcast(mine.select("fold").distinct()))
    return rounded(M.js_distance(mine, whole, ["fold"], "class"), "js")


_CROSS = """vec AS (SELECT vec_id, label, embedding FROM embeddings),
dist AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) * (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE)))) AS d
  FROM vec a JOIN vec b ON a.vec_id <> b.vec_id)"""


@query(
    "m11_silhouette",
    f"""WITH {_CROSS}, m AS (SELECT i, v.label AS other, avg(d) AS d FROM dist JOIN vec v ON v.vec_id = j GROUP BY ALL),
    s AS (SELECT v.vec_id AS id, v.label AS cluster, max(CASE WHEN m.other = v.label THEN d END) AS a, min(CASE WHEN m.other <> v.label THEN d END) AS b FROM vec v LEFT JOIN m ON m.i = v.vec_id GROUP BY ALL)
    SELECT id, cluster, round(CASE WHEN (SELECT count(*) FROM vec w WHERE w.label = s.cluster) = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""",
)
def silhouette(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster"))
    return rounded(M.silhouette_of_vectors(vec), "silhouette")
