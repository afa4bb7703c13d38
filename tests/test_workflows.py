import math
import random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from zymolith.__main__ import main
from zymolith.plans import workflows as W

COLUMNS = "id string, sequence string, type string, substrate_name string, product string, fragment string, product_is_major_raw string, kingdom_raw string"
GPP = "CC(C)=CCCC(C)=CCOP([O-])(=O)OP([O-])([O-])=O"


def reactions(spark):
    ten, other = "C1CC(C(C)=C)CC=C1C", "CC(C)=CCC\\C(C)=C\\C"
    rows = [
        (" a ", "MK LV*", "mono", "(2E)-GPP", ten, None, None, "Coral"),
        ("a", "MKLV", "mono", "(2E)-GPP", other, None, "yes", "Plantae"),
        ("b", "QQ", "gpps", "(2E)-GPP", ten, None, None, "Fungi"),
        ("c", "QQ", "mono", "(2E)-GPP", "CC", None, None, "Fungi"),
        ("d", None, "mono", "(2E)-GPP", ten, None, None, "Fungi"),
        ("e", "QQ", "mono", "no such name", ten, None, None, "Fungi"),
        ("f", "QQ", "mono", "(2E)-GPP", ten, "Yes", None, "Fungi"),
        ("g", "QQ", "mono", "Unknown", None, None, None, None),
        ("h", "QQ", "mono", "(2E)-GPP", "a ketone", None, None, None),
        ("x", "QQ", "mono", "(2E)-GPP", ten, None, None, None),
        ("m", "QQ", "Negative", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_prepared_table(spark):
    negatives = spark.createDataFrame([("n1", "MK"), ("n2", "MU"), ("a", "MK")], "id string, sequence string")
    table = W.prepared(reactions(spark), negatives, spark.createDataFrame([("x",)], "id string"))
    got = sorted((r.id, r.sequence, r.substrate, r["product"], r.kingdom or "", r.product_is_major) for r in table.collect())
    assert got == [
        ("a", "MKLV", GPP, "C1CC(C(C)=C)CC=C1C", "Animals", False),
        ("a", "MKLV", GPP, "CC(C)=CCCC(C)=CC", "Plants", True),
        ("b", "QQ", "precursor substr", "C1CC(C(C)=C)CC=C1C", "Fungi", True),
        ("g", "QQ", "Unknown", "Unknown", "", True),
        ("m", "QQ", "Negative", "Unknown", "", True),
        ("n1", "MK", "Unknown", None, "", False),
    ]
    labels = {r.id: r.labels for r in W.examples(table).collect()}
    assert labels == {"a": [GPP, "isTPS"], "b": ["precursor substr"], "g": ["Unknown"], "m": ["Negative", "isTPS"], "n1": ["Unknown"]}


def test_folds_do_not_leak(spark):
    rnd = random.Random(1)
    rows = [(f"p{i}", "M", "mono", rnd.choice(["s1", "s2"]), "C", "k", True) for i in range(60)] + [(f"n{i}", "M", "Negative", "Unknown", None, None, False) for i in range(40)]
    table = spark.createDataFrame(rows, "id string, sequence string, type string, substrate string, product string, kingdom string, product_is_major boolean")
    clades = spark.createDataFrame([(f"p{i}", i // 6) for i in range(60)], "id string, clade int")
    out = {r.id: r.fold for r in W.with_folds(table, clades, 5, 10).collect()}
    assert len(out) == 100 and all(len({out[f"p{i}"] for i in range(6 * c, 6 * c + 6)}) == 1 for c in range(10))
    counts = [sum(out[f"n{i}"] == f for i in range(40)) for f in range(5)]
    assert counts == [8] * 5


def test_train_evaluate_and_command_line(spark, tmp_path):
    df = spark.range(300).select("id", array_to_vector(F.array(F.col("id") % 7 / 7.0, F.col("id") % 3 / 3.0)).alias("features"), F.when(F.col("id") % 7 > 3, F.array(F.lit("big"), F.lit("isTPS"))).otherwise(F.array(F.lit("Unknown"))).alias("labels"), (F.col("id") % 3).cast("int").alias("fold"))
    preds = W.train_and_score(df, ["big", "isTPS", "Unknown"], "logistic_regression", {"maxIter": 20}, "lr", range(3)).cache()
    assert preds.count() == 900
    per_class, summary = W.evaluated(W.fold_scores(preds), 3)
    assert {r["class"] for r in per_class.collect()} == {"big", "isTPS"}
    assert all(r.mean > 0.99 and r.lower <= r.mean <= r.upper for r in summary.where("metric <> 'mccf1'").collect())
    categories = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(200)], "id long, category string")
    assert {r["class"] for r in W.fold_scores(preds, categories).collect()} == {"x_|_big", "y_|_big", "x_|_isTPS", "y_|_isTPS"}
    best, loss = W.tuned(df.drop("fold"), ["big"], "logistic_regression", {"regParam": [0.01, 0.1]}, 2, {"regParam": 0.01})
    assert best["regParam"] in (0.01, 0.1) and 0 <= loss < 0.1
    preds.write.parquet(f"{tmp_path}/preds")
    assert main(["evaluate", f"{tmp_path}/preds", f"{tmp_path}/out", "--folds", "3"]) == 0
    back = spark.read.option("header", True).csv(f"{tmp_path}/out/summary").collect()
    assert {r.metric for r in back} == {"ap", "auc", "mccf1"} and all(math.isfinite(float(r.mean)) for r in back)
    assert main(["query", "p1_dictionary_map", "/root/testdata/sf0.001", f"{tmp_path}/q"]) == 0 and spark.read.parquet(f"{tmp_path}/q").count() == 150


def test_screening_of_a_file(spark, tmp_path):
    p = tmp_path / "s.fasta"
    p.write_text("".join(f">s{k} x\n{'A' * (k + 1)}\n" for k in range(20)) + ">u\nAAU\n")
    done = spark.createDataFrame([("s15",)], "id string")
    out = W.screened(spark, str(p), lambda: lambda t: [(len(x) / 20, 0.1) for x in t], ["isTPS", "c-1"], 1, 0.5, 5, 18, done)
    assert sorted(r.id for r in out.collect()) == sorted(f"s{k}" for k in range(9, 18) if k != 15)
