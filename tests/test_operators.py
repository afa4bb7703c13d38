import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zymolith.operators import cleaning as C
from zymolith.operators import clustering as K
from zymolith.operators import folds as D
from zymolith.operators import labels as L
from zymolith.operators import pairs as P
from zymolith.operators import relations as R
from zymolith.operators import segments as S
from zymolith.operators import structure as G
from zymolith.operators import trees as T


def values(spark, xs, key="k"):
    return spark.createDataFrame([(key, x) for x in xs], "key string, value int")


def column(df, name="value"):
    return sorted(r[name] for r in df.collect())


def value_of(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_compressed_and_back(spark):
    r = S.compressed(values(spark, [1, 2, 3, 5, 7, 8]), ["key"]).first()
    assert r.selection == "1-3+5+7-8"
    assert value_of(spark, S.parse_selection(F.lit("1-3+5+7-8"))) == [1, 2, 3, 5, 7, 8]
    assert value_of(spark, S.parse_selection(F.lit(""))) == []
    rnd = random.Random(0)
    xs = sorted({rnd.randrange(100) for _ in range(40)})
    text = S.compressed(values(spark, xs), ["key"]).first().selection
    assert value_of(spark, S.parse_selection(F.lit(text))) == xs


def test_gap_fill_segments_and_halving(spark):
    assert column(S.gap_filled(values(spark, [1, 4, 10]), ["key"])) == [1, 2, 3, 4, 10]
    got = S.long_segments(values(spark, [1, 2, 4, 5, 20, 21, 30, 33, 36]), ["key"], 3, gap=2).collect()
    assert [(r.lo, r.hi) for r in got] == [(1, 5)]
    assert S.halved(1, 16, 7) == [(1, 8), (9, 16)]
    seg = spark.createDataFrame([(1, 16), (3, 5)], "lo int, hi int")
    assert sorted((r.lo, r.hi) for r in S.halved_segments(seg, 7).collect()) == [(1, 8), (3, 5), (9, 16)]


def test_longest_segment_ties_and_blocks(spark):
    got = S.longest_segment(values(spark, [1, 2, 10, 20, 21, 22, 40]), values(spark, [15, 30]), ["key"])
    assert column(got) == [1, 2, 10]  # two islands of three, the first wins; the gap of eight stays


def test_alignment_positions(spark):
    df = spark.createDataFrame([(1, "AC", "A-C"), (2, "A C", "AC")], "id int, o string, a string")
    got = {(r.id, r.original_pos): r.aligned_pos for r in S.alignment_positions(df, "id", "o", "a").collect()}
    assert got == {(1, 0): 0, (1, 1): 2, (2, 0): 0, (2, 2): 1}


def test_two_nearest_mean(spark):
    known = spark.createDataFrame([("f", 1, 2.0), ("f", 4, 3.0), ("f", 9, 8.0)], "f string, at int, value double")
    want = spark.createDataFrame([("f", 3), ("f", 8), ("g", 1)], "f string, at int")
    got = {(r.f, r["at"]): r.value for r in S.two_nearest_mean(known, want, ["f"]).collect()}
    assert got == {("f", 3): 2.0, ("f", 8): 6.0, ("g", 1): None}  # 2.5 and 5.5 go to even


def sequential_carry(rows):
    out, pending = [], False
    for o, black, sel in rows:
        if black:
            pending = sel
        else:
            if sel or pending:
                out.append(o)
            pending = False
    return out


def test_carry_forward(spark):
    def run(rows):
        return column(R.carry_forward_sample(spark.createDataFrame(rows, "o int, b boolean, s boolean"), "o", "b", "s"), "o")

    assert run([(o, o in {1, 2, 4}, o in {0, 1, 4}) for o in range(6)]) == [0, 5]
    rnd = random.Random(1)
    for _ in range(5):
        rows = [(o, rnd.random() < 0.5, rnd.random() < 0.5) for o in range(60)]
        assert run(rows) == sequential_carry(rows)


def test_recall_overlap_is_not_symmetric(spark):
    def hits(new, known):
        n = spark.createDataFrame([("f", 1, x) for x in new], "f string, new_id int, x int")
        k = spark.createDataFrame([("f", 2, x) for x in known], "f string, known_id int, x int")
        return R.recall_overlap(n, k, ["f"], "x").count()

    assert hits([3, 4, 5, 6], [1, 2, 3, 4]) == 1 and hits(range(1, 11), [3, 4]) == 0 and hits([3, 4], range(1, 11)) == 1


def test_priority_merge_only_looks_at_earlier_groups(spark):
    rows = [("f", "a", 1, x) for x in range(4)] + [("f", "b", 2, x) for x in (2, 3)] + [("f", "b", 3, x) for x in (8, 9)] + [("f", "b", 4, x) for x in (8, 9)]
    df = spark.createDataFrame(rows, "f string, g string, s int, x int")
    assert {r.s for r in R.priority_merge(df, ["a", "b"], ["f"], "g", "s", "x").collect()} == {1, 3, 4}


def test_label_rules(spark):
    aug = lambda *x: value_of(spark, L.augmented(F.array(*[F.lit(v) for v in x])))
    assert aug("s1") == ["isTPS", "s1"] and aug("Unknown") == ["Unknown"] and aug("precursor substr", "s1") == ["precursor substr", "s1"]
    balanced = lambda a, b: value_of(spark, C.carbon_balanced(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert balanced("CCO", "CCN") and balanced("ClC", "CC") and balanced(None, "C") is False
    major = lambda n, f: value_of(spark, C.major_product(F.lit(n), F.lit(f).cast("string")))
    assert major(1, None) and not major(2, None) and major(2, "YES") and not major(1, "No")
    assert value_of(spark, C.squeezed(F.lit("A B \tC\n"))) == "ABC"
    sets = spark.createDataFrame([(1, None), (None, "a"), (1, "b")], "k int, t string")
    assert L.label_sets(sets, "k", "t").first().labels == ["b"]
    assert L.label_sets(sets, "k", "t", null_label="?").first().labels == ["?", "b"]


def test_first_last_and_leaks(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), (None, 5, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in R.first_per_key(df, ["k"], ["o"]).collect()} == {("a", None), (None, "z")}
    assert [(r.k, r.v) for r in R.last_value_per_key(df, "k", "v", ["o"]).collect()] == [("a", "y")]
    R.assert_disjoint(df.where("k = 'a'"), df.where("k is null"), ["k"])
    with pytest.raises(ValueError, match="shared"):
        R.assert_disjoint(df, df, ["k"])


TREE = [("root", None, None), ("in", "root", 0.2), ("x", "in", 0.1), ("y", "in", 0.3)]


def test_tree_depths_and_clusters(spark):
    edges = spark.createDataFrame(TREE, "node string, parent string, length double")
    depth = {r.node: round(r.depth, 6) for r in T.max_depths(edges).collect()}
    assert depth == {"root": 0.5, "in": 0.5, "x": 0.1, "y": 0.3}
    assert {(r.leaf, r.root) for r in T.clade_clusters(edges, 0.4).collect()} == {("x", "x"), ("y", "y")}
    assert {r.root for r in T.clade_clusters(edges, 0.6).collect()} == {"root"}
    assert {r.cluster for r in T.numbered(T.clade_clusters(edges, 0.4)).collect()} == {0, 1}


def test_group_folds_keep_groups_whole(spark):
    rnd = random.Random(2)
    rows = [(i, f"g{rnd.randrange(40)}", rnd.choice("abc")) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, group string, label string")
    place = D.group_kfold(D.group_counts(df), 5, 20)
    folds = {r["group"]: r.fold for r in place.collect()}
    assert set(folds) == {g for _, g, _ in rows} and set(folds.values()) == set(range(5))
    sizes = [sum(folds[g] == f for _, g, _ in rows) for f in range(5)]
    assert max(sizes) - min(sizes) < 60
    assert folds == {r["group"]: r.fold for r in D.group_kfold(D.group_counts(df), 5, 20).collect()}


def test_group_kfold_balances_many_groups(spark, monkeypatch):
    """Beyond the limit: five large groups that one hash would put together, a class of five groups, many small ones."""
    monkeypatch.setattr(D, "MAX_GROUPS", 400)
    hashed = spark.range(3000).selectExpr("concat('g', id) AS g", "pmod(xxhash64(concat('g', id)), 5) AS h").collect()
    together = [r.g for r in hashed if r.h == 0]
    rows = [(g, "common", 1000) for g in together[:5]] + [(g, "rare", 1) for g in together[5:10]]
    rows += [(r.g, "ab"[k % 2], 1 + k % 3) for k, r in enumerate(hashed) if r.g not in together[:10]]
    place = {r["group"]: r.fold for r in D.group_kfold(spark.createDataFrame(rows, "group string, label string, n long"), 5, 10).collect()}
    assert set(place) == {g for g, *_ in rows}
    for label in ("common", "rare", "a", "b"):
        sums = [sum(n for g, k, n in rows if k == label and place[g] == f) for f in range(5)]
        assert max(sums) <= 1.1 * sum(sums) / 5, (label, sums)


def test_pairs_cover_the_triangle(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(23)], "id int, v array<double>")
    got = sorted((r.i, r.j) for r in P.triangle(items, "v", blocks=4).collect())
    assert got == [(i, j) for i in range(23) for j in range(i + 1, 23)]
    edges = P.euclidean_pairs(items, "v")
    full = {(r.i, r.j): r.d for r in P.mirrored(edges).collect()}
    assert len(full) == 23 * 23 and all(full[i, j] == full[j, i] == abs(i - j) for i in range(23) for j in range(23))


def test_noise_is_filled_in_order():
    d = np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0)))
    assert P.fill_noise(d, np.array([0, -1, -1, 1, 1])).tolist() == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        P.fill_noise(d, np.full(5, -1))


def test_medoids_and_density():
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), rng.normal((0, 9), 0.1, (30, 2))])
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    _, where, costs = K.kmedoids(d, 3)
    assert all(a >= b for a, b in zip(costs, costs[1:], strict=False))
    truth = np.repeat([0, 1, 2], 30)
    same = lambda x: all(len(set(x[truth == k])) == 1 for k in range(3)) and len(set(x)) == 3
    assert same(where) and K.best_k(d, range(2, 6))[0] == 3
    noisy = np.concatenate([pts, [[50.0, 50.0]]])
    dn = np.sqrt(((noisy[:, None] - noisy[None]) ** 2).sum(2))
    labels = K.density_clusters(dn, 5)
    assert same(labels[:90]) and labels[90] == -1


def test_shifted_mapping():
    assert G.shifted_mapping([(1, 11), (2, 12)], [1, 2, 3, 4], range(10, 20)) == {1: 11, 2: 12, 3: 13, 4: 14}
    assert G.shifted_mapping([(1, 3), (5, 5)], [1, 3, 5], range(10)) == {1: 3, 3: 4, 5: 5}
