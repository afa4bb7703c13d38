import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from zymolith.operators import learning as L
from zymolith.streaming import screening as X


def data(spark, n=200):
    df = spark.range(n).withColumn("x", F.array(F.col("id") % 7 / 7.0, F.col("id") % 3 / 3.0))
    labels = F.array_distinct(F.array(F.when(F.col("id") % 7 > 3, "big").otherwise("small"), F.lit("all")))
    return df.select("id", array_to_vector("x").alias("features"), labels.alias("labels"))


def test_one_vs_rest_skips_classes_of_one_outcome(spark):
    rows = data(spark)
    model = L.OneVsRest("logistic_regression", {"maxIter": 20}, {"big": {"maxIter": 40}}, balanced=True).fit(rows, ["big", "all", "none"])
    assert set(model.models) == {"big"}
    out = model.predict(rows, ["big", "all", "none"])
    assert out.count() == 600 and out.where("class <> 'big' and score <> 0").count() == 0
    good = out.where("class = 'big'").join(rows, "id").where((F.col("score") > 0.5) == F.array_contains("labels", "big")).count()
    assert good == 200


def test_saved_models_score_alike(spark, tmp_path):
    rows = data(spark, 60)
    model = L.OneVsRest("random_forest", {"numTrees": 3, "seed": 1}).fit(rows, ["big", "all"])
    model.save(f"{tmp_path}/m")
    again = L.gathered_folds(spark, [f"{tmp_path}/m"])[0]
    key = lambda m: sorted(tuple(r) for r in m.predict(rows, ["big", "all"]).collect())
    assert again.learner == "random_forest" and key(again) == key(model)


def test_features_use_training_owners_only(spark):
    sims = spark.createDataFrame([(1, "f1", 0.5), (1, "f2", 0.7), (2, "f3", 0.9)], "id int, feature string, value double")
    owners = spark.createDataFrame([("f1", "d", 1), ("f2", "d", 2), ("f3", "d", 1)], "feature string, domain string, owner int")
    long = L.train_features(sims, owners, spark.createDataFrame([(1,)], "id int"))
    assert sorted(tuple(r) for r in long.collect()) == [(1, 0, 0.5), (2, 1, 0.9)]
    assert {r.id: r.domains for r in L.feature_arrays(long, 3).collect()} == {1: [0.5, 0.0, 0.0], 2: [0.0, 0.9, 0.0]}


def test_ensemble_names_and_mean(spark):
    df = spark.createDataFrame([("a", "x-y", 0.2), ("a", "x-y", 0.6), ("a", "Unknown", 0.9)], "id string, class string, score double")
    assert [tuple(r) for r in L.ensemble_mean(df, 2).collect()] == [("a", "x_y", 0.4)]


def test_pca_is_centred(spark):
    out, shares = L.pca(data(spark))
    means = out.select(F.avg(F.col("pc")[0]), F.avg(F.col("pc")[1])).first()
    assert all(abs(m) < 1e-9 for m in means) and abs(sum(shares) - 1) < 1e-9


def test_search_starts_from_the_given_point():
    seen = []
    best, value = L.random_search({"a": [1, 2, 3]}, 5, lambda p: seen.append(p) or abs(p["a"] - 2), {"a": 2})
    assert seen[0] == {"a": 2} and best == {"a": 2} and value == 0


def test_rows_out_of_memory_are_kept_apart(spark):
    def load():
        def model(texts):
            if any(len(t) > 5 for t in texts):
                raise MemoryError("too long")
            return [(len(t) / 10,) for t in texts]

        return model

    df = spark.createDataFrame([("a", "AC"), ("b", "ACDEFGH"), ("c", "A")], "id string, sequence string").coalesce(1)
    got = {r.id: (r.score, r.error) for r in X.scored(df, load, ["p"]).collect()}
    assert got["a"] == (0.2, None) and got["c"] == (0.1, None) and got["b"][0] is None and "memory" in got["b"][1]
    assert X.workers(640_000) == 3


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, sink, marks = (f"{tmp_path}/{x}" for x in ("src", "sink", "marks"))
    first = spark.createDataFrame([(f"a{k}", "x") for k in range(10)], "id string, sequence string")
    first.write.parquet(src)
    step = lambda df: df.withColumn("n", F.length("sequence"))
    X.screen_stream(spark, src, "id string, sequence string", step, sink, marks)
    spark.createDataFrame([("a3", "again"), ("b", "new")], "id string, sequence string").write.mode("append").parquet(src)
    X.screen_stream(spark, src, "id string, sequence string", step, sink, marks)
    got = spark.read.parquet(sink).toPandas()
    assert isinstance(got, pd.DataFrame) and sorted(got["id"]) == sorted([f"a{k}" for k in range(10)] + ["b"])


def test_bayesian_search_finds_the_valley(spark, tmp_path):
    seen = []
    space = {"a": list(range(10)), "b": list(range(10)), "kind": ["x", "y"]}
    loss = lambda p: seen.append(dict(p)) or (p["a"] - 6) ** 2 + (p["b"] - 3) ** 2 + (p["kind"] == "x")
    best, value = L.bayesian_search(space, 40, loss, {"a": 0, "b": 0, "kind": "x"})
    assert seen[0] == {"a": 0, "b": 0, "kind": "x"} and value <= 2 and len(seen) == 40 and len({tuple(p.values()) for p in seen}) == 40
    to = str(tmp_path / "best")
    assert L.keep_params(to, best, value) and not L.keep_params(to, {"a": 1}, value + 1) and L.kept_params(to)[0] == best
