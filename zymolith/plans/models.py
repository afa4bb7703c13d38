"""Model and clustering queries over the driver's vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import density as N
from ..operators import learning as L
from ..operators import medoids as D
from ..operators import metrics as M
from ..operators import multi_output as X
from ..operators import profiles as H
from ..operators import relations as R
from ..operators import search as Q
from .registry import query, r6, rounded, table

CLASSES = ["c0", "c1", "c2"]


def examples(spark, d):
    """(id, features, labels): vectors; an item has the label of its class, and every even class ``c0`` too."""
    e = table(spark, d, "embeddings")
    labels = F.array_distinct(F.filter(F.array(F.concat(F.lit("c"), F.col("label").cast("string")), F.when(F.col("label") % 2 == 0, F.lit("c0"))), lambda x: x.isNotNull()))
    vec = L.joined_features(e.select(F.col("vec_id").alias("id"), "embedding"), None, 0)
    return vec.join(e.select(F.col("vec_id").alias("id"), labels.alias("labels")), "id")


def _scores(spark, d, learner, **params):
    rows = examples(spark, d)
    model = L.OneVsRest(learner, params, balanced=True).fit(rows.where("id % 5 <> 0"), CLASSES)
    return model.predict(rows.where("id % 5 = 0"), [*CLASSES, "absent"])


@query("l1_random_forest")
def l1(spark, d):
    return rounded(_scores(spark, d, "random_forest", numTrees=10, maxDepth=4, seed=1), "score")


@query("l2_boosted_trees")
def l2(spark, d):
    return rounded(_scores(spark, d, "boosted_trees", maxIter=3, maxDepth=3, seed=1), "score")


@query("l3_logistic_regression")
def l3(spark, d):
    return rounded(_scores(spark, d, "logistic_regression", regParam=0.01, maxIter=30), "score")


@query("l4_perceptron")
def l4(spark, d):
    return rounded(_scores(spark, d, "perceptron", layers=[64, 8, 2], maxIter=20, seed=1), "score")


@query(
    "l5_train_features",
    """WITH sims AS (SELECT l_orderkey AS id, l_suppkey AS feature, round(sum(l_discount), 6) AS value FROM lineitem GROUP BY ALL),
    pos AS (SELECT DISTINCT s_suppkey AS feature, dense_rank() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier WHERE s_nationkey % 5 <> 0)
    SELECT id, position::INTEGER AS position, value FROM sims JOIN pos USING (feature)""",
)
def l5(spark, d):
    """Similarities of orders to suppliers' domains; suppliers of a fifth of the nations are test domains."""
    sims = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("feature")).agg(F.sum("l_discount").cast("double").alias("value"))
    owners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("feature"), F.col("s_nationkey").alias("owner"), F.concat(F.lit("d"), "s_suppkey").alias("domain"))
    train = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("id"))
    return rounded(L.train_features(sims, owners, train), "value")


@query("l6_missing_classes", "SELECT vec_id AS id, class, 0.0::DOUBLE AS score FROM embeddings CROSS JOIN (VALUES ('x'), ('y')) c(class)")
def l6(spark, d):
    return L.OneVsRest("random_forest").predict(examples(spark, d), ["x", "y"])


@query("l1_shared_forest")
def l1s(spark, d):
    """Trees whose leaves score all labels."""
    rows = examples(spark, d)
    model = X.SharedForest(trees=10, depth=4, seed=1).fit(rows.where("id % 5 <> 0"), CLASSES)
    return rounded(model.predict(rows.where("id % 5 = 0"), [*CLASSES, "absent"]), "score")


@query("l2_newton_boosting")
def l2n(spark, d):
    """Boosting by gradients and curvatures, a tree a label and round."""
    rows = examples(spark, d)
    model = X.NewtonBoosting(rounds=3, depth=3).fit(rows.where("id % 5 <> 0"), CLASSES)
    return rounded(model.predict(rows.where("id % 5 = 0"), [*CLASSES, "absent"]), "score")


@query("l4_shared_perceptron")
def l4s(spark, d):
    """One network with a logistic output for each label."""
    rows = examples(spark, d)
    model = X.SigmoidNetwork(hidden=(8,), steps=10, seed=1).fit(rows.where("id % 5 <> 0"), CLASSES)
    return rounded(model.predict(rows.where("id % 5 = 0"), [*CLASSES, "absent"]), "score")


@query("l23_one_of_all")
def l23(spark, d):
    """A class scored by a model that has learnt all labels along with it."""
    rows = examples(spark, d)
    model = X.SharedForest(trees=5, depth=5, seed=2).fit(rows.where("id % 5 <> 0"), CLASSES)
    return rounded(model.predict(rows.where("id % 5 = 0"), ["c1"]), "score")


@query("l7_bayesian_search")
def l7(spark, d):
    rows = examples(spark, d).cache()
    train, test = rows.where("id % 5 > 1"), rows.where("id % 5 = 0")

    def loss(params: dict) -> float:
        scores = L.OneVsRest("logistic_regression", params).fit(train, ["c0"]).predict(test, ["c0"])
        preds = scores.join(test.select("id", F.array_contains("labels", "c0").cast("int").alias("label")), "id")
        return 1 - M.average_precision(M.counts_curve(preds, ["class"]), ["class"]).first()["ap"]

    best, value = L.bayesian_search({"regParam": [0.001, 0.01, 0.1], "maxIter": [5, 10]}, 3, loss, {"regParam": 0.01, "maxIter": 10})
    rows.unpersist()
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(best.items())] + [("loss", float(value))], "name string, value double")


@query("l12_split_importances")
def l12(spark, d):
    rows = examples(spark, d).where("id % 5 <> 0")
    model = L.OneVsRest("random_forest", {"numTrees": 10, "maxDepth": 4, "seed": 1}).fit(rows, ["c0"]).models["c0"]
    found = spark.createDataFrame(L.importances(model), "position int, importance double")
    places = spark.range(14).select(F.col("id").cast("int").alias("position"), F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("domain"))
    forced = spark.createDataFrame([("d9",)], "domain string")
    _, domains = L.split_importances(found, 50, places, forced)
    return rounded(domains, "importance")


@query("l13_pca")
def l13(spark, d):
    out, _ = L.pca(examples(spark, d))
    return out.select("id", r6(F.abs(F.col("pc")[0])).alias("pc1"), r6(F.abs(F.col("pc")[1])).alias("pc2"))


_CELL = "list_sum(list_transform(range(1, 65), lambda k: {a}[k] * {b}[k]))"


@query(
    "m12_explained_variance",
    # the first share by power iteration on the covariance, the sum of all shares from its trace
    f"""WITH RECURSIVE long AS (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
    mean AS (SELECT k, avg(x) AS m FROM long GROUP BY k), c AS (SELECT vec_id, k, x - m AS x FROM long JOIN mean USING (k)),
    cov AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) / (count(*) - 1) AS v FROM c a JOIN c b USING (vec_id) GROUP BY ALL),
    rows AS (SELECT i, list(v ORDER BY j) AS r FROM cov GROUP BY i), m AS (SELECT list(r ORDER BY i) AS m FROM rows),
    p(n, v, top) AS (SELECT 0, list_transform(range(1, 65), lambda k: 1 + (k % 7) / 10.0::DOUBLE), 0::DOUBLE UNION ALL
      SELECT n + 1, list_transform(w, lambda x: x / sqrt({_CELL.format(a="w", b="w")})), sqrt({_CELL.format(a="w", b="w")})
      FROM (SELECT n, list_transform(m, lambda r: {_CELL.format(a="r", b="v")}) AS w FROM p, m WHERE n < 3000))
    SELECT round(max(top) FILTER (n = 3000) / (SELECT sum(v) FROM cov WHERE i = j), 4) AS first, true AS falling FROM p""",
)
def m12(spark, d):
    _, shares = L.pca(examples(spark, d))
    return spark.createDataFrame([(round(float(shares[0]), 4), bool(shares[0] >= shares[1] > 0 and sum(shares) <= 1))], "first double, falling boolean")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("l14_kmedoids")
def l14(spark, d):
    return D.kmedoids_of_vectors(_vectors(spark, d), 5)[0]


@query("l14_best_k")
def l14b(spark, d):
    k, means, clusters = D.best_k_of_vectors(_vectors(spark, d), range(2, 8))
    return clusters.select("id", "cluster", F.lit(k).alias("k"), F.lit(round(means[k], 6)).alias("silhouette"))


@query("l15_density_clusters")
def l15(spark, d):
    return N.density_clusters(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 5)


@query("j17_fill_noise")
def j17b(spark, d):
    """Every fiftieth item has no label and takes that of its neighbours."""
    v = _vectors(spark, d)
    labels = v.select("id", F.when(F.col("id") % 50 == 0, -1).otherwise(F.col("id") % 3).alias("label"))
    return D.filled_noise_of_vectors(v, labels)


@query("l22_latest_params", "SELECT user_id, last(event_type ORDER BY ts, event_id) AS params FROM events GROUP BY user_id")
def l22(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("params"), F.struct("ts", "event_id").alias("ts"))
    return L.latest_params(e, ["user_id"])


@query(
    "j19_kmer_nearest",
    """WITH k AS (SELECT DISTINCT item_id, substr(text, p::BIGINT, 6) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - 4)) AS p FROM benchmark)), n AS (SELECT item_id, count(*) AS n FROM k GROUP BY item_id),
    s AS (SELECT a.item_id AS i, b.item_id AS j, count(*) / (max(x.n) + max(y.n) - count(*)) AS score FROM k a JOIN k b ON a.kmer = b.kmer AND a.item_id <> b.item_id JOIN n x ON x.item_id = a.item_id JOIN n y ON y.item_id = b.item_id GROUP BY ALL)
    SELECT i AS id, j AS nearest, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM s) WHERE r = 1""",
)
def j19(spark, d):
    """The native stand-in of a sequence search: nearest other item by shared 6-letter words."""
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.expr("transform(sequence(1, length(text) - 5), p -> substring(text, p, 6))")).alias("kmer")).distinct()
    sizes = b.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    other = b.select(F.col("item_id").alias("j"), "kmer")
    common = b.join(other, "kmer").where("item_id <> j").groupBy("item_id", "j").agg(F.count(F.lit(1)).alias("c"))
    both = common.join(sizes, "item_id").join(sizes.select(F.col("item_id").alias("j"), F.col("n").alias("m")), "j")
    both = both.withColumn("score", F.col("c") / (F.col("n") + F.col("m") - F.col("c")))
    return R.top_k(both, ["item_id"], [F.desc("score"), F.asc("j")], 1).select(F.col("item_id").alias("id"), F.col("j").alias("nearest"), r6("score").alias("score"))


@query("j19_sequence_search")
def j19_search(spark, d):
    """The two nearest other items of each item by local alignment; letters are scored by identity only."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("sequence"))
    out = Q.nearest_sequences(b, b, 2, scoring=Q.Scoring(same=5, other=-4, groups=()), short=6, long=12, other_ids=True)
    return out.select("query", "reference", "score", r6("bits").alias("bits"), r6("expected").alias("expected"), "rank")


@query("l17_profile_scores")
def l17(spark, d):
    """Profiles of the type texts of the parts of each brand, blanks as gaps; all part names are scored by each."""
    p = table(spark, d, "part")
    known = H.profiles(p.select(F.col("p_brand").alias("class"), F.translate("p_type", " ", "-").alias("aligned")))
    return rounded(H.profile_scores(p.select(F.col("p_partkey").alias("id"), F.translate("p_name", " ", "").alias("sequence")), known), "score")


@query("l7_hedged_search")
def l7h(spark, d):
    """Penalty and number of steps of a logistic fit, searched over ranges; the folds of each trial are one job."""
    rows = table(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(3)).cast("int").alias("fold"), "embedding", (F.col("label") % 2).cast("int").alias("y"))

    def fit_and_score(params, train, test):
        x, z = (np.stack(t["embedding"].to_numpy()).astype(float) for t in (train, test))
        w = np.zeros(x.shape[1])
        for _ in range(params["steps"]):
            p = 1 / (1 + np.exp(-x @ w))
            w = np.linalg.solve((x.T * (p * (1 - p))) @ x + params["penalty"] * np.eye(len(w)), (x.T * (p * (1 - p))) @ (x @ w) + x.T @ (train["y"].to_numpy() - p))
        return float(np.logaddexp(0, -(2 * test["y"].to_numpy() - 1) * (z @ w)).mean())

    space = {"penalty": L.Dimension(1e-3, 100.0, logarithmic=True), "steps": L.Dimension(1, 8, whole=True)}
    best, value = L.hedged_search(space, 9, L.grouped_fold_losses(rows, fit_and_score), {"penalty": 1.0, "steps": 4}, first=2, batch=3)
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in sorted(best.items())] + [("loss", round(value, 4))], "name string, value double")
