"""Groups, orders and trees that would put most rows into one task or many rounds, against plain recomputation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from zymolith.functions.running import ordinals, running_sums
from zymolith.operators import folds as K
from zymolith.operators import metrics as M
from zymolith.operators import pairs as P
from zymolith.operators import relations as R
from zymolith.operators import segments as S
from zymolith.operators import structure as G
from zymolith.operators import trees as T
from zymolith.sources import tables, text_formats


def test_running_sums_of_values_that_pile_up(spark):
    """Nine in ten scores lie in a thousandth of the range."""
    rnd = random.Random(1)
    values = sorted({rnd.random() / 1000 if rnd.random() < 0.9 else rnd.random() for _ in range(3000)})
    data = spark.createDataFrame([("g", v, 1) for v in values], "k string, o double, v long")
    out = {r.o: r.s for r in running_sums(data, ["k"], "o", {"s": "v"}, buckets=10).collect()}
    assert out == {v: len(values) - n for n, v in enumerate(values)}


def test_ordinals_and_runs_with_ties(spark):
    rows = [(k % 3 if k < 900 else 1, k) for k in range(1000)]
    data = spark.createDataFrame(rows, "a int, b int")
    got = sorted((r.ordinal, r.a) for r in ordinals(data, [F.desc("a")]).collect())
    assert got == list(enumerate(sorted((a for a, _ in rows), reverse=True)))
    want = 1 + sum(rows[k][0] != rows[k - 1][0] for k in range(1, 1000))
    assert tables.run_count(data, "a", "b").first().n == want
    assert ordinals(data.limit(0), ["a"]).count() == 0


def test_samples_are_exact_and_repeat(spark):
    data = spark.range(5000).withColumn("x", F.lit(1))
    one, two = (sorted(r.id for r in R.uniform_sample(data.repartition(n), 1234, ["id"], 3).collect()) for n in (2, 5))
    assert one == two and len(set(one)) == 1234
    assert R.uniform_sample(data, 9999, ["id"]).count() == 5000 and R.uniform_sample(data, 0, ["id"]).count() == 0
    marked = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("p"))
    kept = R.downsample_negatives(marked, F.col("p"), 0.8, "id", -F.col("id"))
    negatives = sorted((r.id for r in kept.where("not p").collect()), reverse=True)
    most = int(100 / (1 - 0.8) - 100)
    assert negatives == [x for x in range(999, -1, -1) if x % 10][:most] and kept.where("p").count() == 100


def test_chain_and_bush_and_cycle(spark):
    n = 300
    rows = [("0", None, 1.0)] + [(str(k), str(k - 1), 0.5) for k in range(1, n)] + [(f"leaf{k}", str(k), 3.0) for k in range(0, n, 7)]
    got = {r.node: r.depth for r in T.max_depths(spark.createDataFrame(rows, "node string, parent string, length double")).collect()}
    want = {}
    for k in reversed(range(n)):
        own, below = (1.0 if k == 0 else 0.5), [want[str(k + 1)]] if k + 1 < n else []
        below += [3.0] if k % 7 == 0 else []
        want[str(k)] = own + max(below, default=0.0)
    want |= {f"leaf{k}": 3.0 for k in range(0, n, 7)}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    with pytest.raises(ValueError):
        T.max_depths(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "node string, parent string, length double"))


def test_null_ids_get_the_same_group_in_every_run(spark):
    rows = spark.createDataFrame([(None, "x"), (None, "y"), ("a", "x")], "id string, label string")
    none = spark.createDataFrame([], "id string, clade string"), spark.createDataFrame([], "id string")
    one, two = (sorted(r.group for r in K.group_ids(rows, *none).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 3


def test_loose_records_over_many_lines(spark, tmp_path):
    text, want = "lost\n", []
    for k in range(400):
        body = [f"AC{k}", " GT "][: k % 3]
        text += f"junk>h{k}\n" + "".join(x + "\n" for x in body)
        want.append((k, f"junkh{k}", "".join(body).replace(" ", "")))
    (tmp_path / "a.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [tuple(r) for r in text_formats.read_fasta_loose(spark, str(tmp_path)).orderBy("ordinal").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_two_nearest_in_a_long_group(spark):
    rnd = random.Random(2)
    known = sorted(rnd.sample(range(5000), 800))
    value = {k: float(rnd.randrange(100)) for k in known}
    want = sorted(rnd.sample(range(-50, 5050), 600))
    a = spark.createDataFrame([("f", k, v) for k, v in value.items()], "f string, at long, value double")
    b = spark.createDataFrame([("f", k) for k in want] + [("none", 1)], "f string, at long")
    got = {(r.f, r["at"]): r.value for r in S.two_nearest_mean(a, b, ["f"]).collect()}
    near = {k: sorted(known, key=lambda x: (abs(x - k), x))[:2] for k in want}
    assert got == {("f", k): float(round(sum(value[x] for x in near[k]) / 2)) for k in want} | {("none", 1): None}


def test_categories_share_counted_negatives(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", "Unknown"]), "c", rnd.randrange(9) / 9, rnd.randrange(2)) for _ in range(500)]
    preds = spark.createDataFrame(rows, "category string, class string, score double, label int")
    plain = M.scores_by_group(M.with_shared_negatives(preds), ["name"])
    got, want = ({r.name: (round(r.ap, 9), round(r.auc, 9), round(r.mccf1, 9)) for r in x.collect()} for x in (M.scores_by_category(preds, []), plain))
    assert got == want and set(got) == {"a_|_c", "b_|_c"}


def test_nearest_regions_and_longest_unmapped(spark):
    rnd = random.Random(5)
    atoms = [(f, r, *(rnd.uniform(-30, 30) for _ in range(3))) for f in (1, 2) for r in range(40)]
    place = {(f, r): xyz for f, r, *xyz in atoms}
    regions = [(f, f"m{m}", r) for f in (1, 2) for m in range(3) for r in range(m * 5, m * 5 + 4)]
    segments = [(f, s, r) for f in (1, 2) for s in range(4) for r in range(20 + s * 5, 23 + s * 5)]
    frames = (spark.createDataFrame(atoms, "file int, residue int, x double, y double, z double"), spark.createDataFrame(segments, "file int, segment int, residue int"), spark.createDataFrame(regions, "file int, module_id string, residue int"))
    got = {(r.file, r.segment): (r.module_id, round(r.distance, 6)) for r in G.nearest_regions(*frames, near=25.0, clearly=0.9).collect()}

    def centre(rows, f, k):
        points = [place[g, r] for g, x, r in rows if (g, x) == (f, k)]
        return [sum(c) / len(points) for c in zip(*points, strict=True)]

    want = {}
    for f in (1, 2):
        for s in range(4):
            d = sorted((math.dist(centre(segments, f, s), centre(regions, f, f"m{m}")), f"m{m}") for m in range(3))
            if d[0][0] < 25.0 and d[0][0] < 0.9 * d[1][0]:
                want[f, s] = (d[0][1], round(d[0][0], 6))
    assert got == want and want

    every = [(1, r) for r in range(100) if not 60 <= r < 75]
    maps = [(1, "a", "alpha", {r: r for r in range(10, 20)}), (1, "b", "beta", {r: r for r in range(30, 50)})]
    left = G.longest_unmapped(spark.createDataFrame(every, "file int, residue int"), spark.createDataFrame(maps, "file int, module_id string, domain string, residues map<int,int>"), ["alpha"])
    blocked, best, run = set(range(10, 20)), [], []
    for r in [*range(100), 200]:
        if r in blocked or r == 200:
            best, run = max(best, run, key=len), []
        elif (1, r) in every:
            run.append(r)
    assert sorted(x[1] for x in left.collect()) == best


def test_matrix_pairs_equal_the_formula(spark):
    rnd = random.Random(8)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(5)]) for k in range(40)] + [(99, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    for measure, formula in (("euclidean", P.euclidean()), ("cosine", P.cosine())):
        want = {(r.i, r.j): round(r.d, 9) for r in P.triangle(v.where("id < 99"), "embedding").select("i", "j", formula.alias("d")).collect()}
        got = [(r.i, r.j, round(r.d, 9)) for r in P.vector_pairs(v, measure, blocks=3).collect()]
        assert len(got) == len(want) == 780 and {(i, j): d for i, j, d in got} == want
    assert P.vector_pairs(v.limit(0), "cosine").count() == 0
