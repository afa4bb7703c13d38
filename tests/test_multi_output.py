import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from zymolith.functions.array_sums import array_sums, cells_of
from zymolith.operators import multi_output as M


def frame(spark, x, y, names):
    rows = [(k, [float(v) for v in x[k]], [n for n, v in zip(names, y[k], strict=True) if v]) for k in range(len(x))]
    return spark.createDataFrame(rows, "id long, features array<double>, labels array<string>").repartition(3).sortWithinPartitions("id")


def scores(df, names):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, {})[r["class"]] = r.score
    return np.array([[out[k][n] for n in names] for k in sorted(out)])


def grown(binned, y, weight, depth, bins, features, least):
    """One tree by recursion over plain rows: Gini over all outputs."""

    def impurity(rows):
        w = weight[rows].sum()
        p = (weight[rows, None] * y[rows]).sum(0) / w if w else np.zeros(y.shape[1])
        return w * (1 - (p * p + (1 - p) ** 2)).sum(), w, p

    out = np.zeros(y.shape)

    def go(rows, level, node, numbers):
        whole, w, p = impurity(rows)
        best = (1e-9 * max(w, 1), None, None)
        open_node = level < depth and (node == 0 or w >= 2 * least and ((p * w > 1e-9) & (p * w < w - 1e-9)).any())
        if open_node:
            for f in features(node):
                for c in range(bins - 1):
                    left, right = rows[binned[rows, f] <= c], rows[binned[rows, f] > c]
                    (a, wa, _), (b, wb, _) = impurity(left), impurity(right)
                    if wa >= least and wb >= least and whole - a - b > best[0] + 1e-12:
                        best = (whole - a - b, f, c)
        out[rows] = p
        if best[1] is not None:
            numbers[level].append((node, rows, best))

    levels = {k: [] for k in range(depth + 1)}
    go(np.arange(len(binned)), 0, 0, levels)
    made = 1
    for level in range(depth):
        for node, rows, (_, f, c) in sorted(levels[level], key=lambda x: x[0]):
            for side in (rows[binned[rows, f] <= c], rows[binned[rows, f] > c]):
                go(side, level + 1, made, levels)
                made += 1
    return out


def test_forest_equals_plain_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (90, 5)).astype(float)
    y = np.stack([x[:, 0] > 2, x[:, 1] + x[:, 2] > 5, rng.random(90) < 0.3], 1).astype(float)
    names = ["a", "b", "c"]
    df = frame(spark, x, y, names)
    model = M.SharedForest(trees=3, depth=4, bins=8, features_per_node=3, least_rows=2.0, seed=5).fit(df, names)
    ids = [(r.row, r.id) for r in df.select(F.xxhash64("id").alias("row"), "id").collect()]
    row = np.array([r for r, _ in sorted(ids, key=lambda p: p[1])])
    binned = M.to_bins(x, model.cuts)
    want = [grown(binned, y, M.bootstrap_weights(row, t, 5), 4, 8, lambda n, t=t: M.node_features(5, t, n, 5, 3), 2.0) for t in range(3)]
    got = scores(model.predict(df, [*names, "absent"]), [*names, "absent"])
    assert np.allclose(got[:, :3], np.mean(want, 0)) and (got[:, 3] == 0).all()


def test_bootstrap_draws_are_poisson():
    w = M.bootstrap_weights(np.arange(200_000), 3, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w, M.bootstrap_weights(np.arange(200_000), 4, 1))[0, 1]) < 0.01


def test_more_label_sets_than_rows_of_each(spark):
    """Ten labels that each depend on their own feature: 1,024 possible sets, hardly one twice."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 10))
    y = (x > 0.2).astype(float)
    names = [f"c{k}" for k in range(10)]
    train, test = frame(spark, x[:600], y[:600], names), frame(spark, x[600:], y[600:], names)
    assert len({tuple(r) for r in y[:600]}) > 400
    forest = scores(M.SharedForest(trees=12, depth=7, bins=16, features_per_node=6, seed=1).fit(train, names).predict(test, names), names)
    assert ((forest > 0.5) == (y[600:] > 0)).mean() > 0.83
    net = M.SigmoidNetwork(hidden=(16,), steps=30, alpha=1e-3).fit(train, names)
    assert ((scores(net.predict(test, names), names) > 0.5) == (y[600:] > 0)).mean() > 0.93
    assert net.losses == sorted(net.losses, reverse=True)


def newton(binned, y, rounds, depth, bins, rate, penalty, cost, least, loss):
    """A plain booster: margins of all rows."""
    margin = np.zeros(y.shape)
    for _ in range(rounds):
        if loss == "softmax":
            e = np.exp(margin - margin.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
        else:
            p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum((2 if loss == "softmax" else 1) * p * (1 - p), 1e-16)
        for k in range(y.shape[1]):

            def go(rows, level, k=k):
                gs, hs = g[rows, k].sum(), h[rows, k].sum()
                best = (1e-12, None, None)
                if level < depth:
                    for f, c in itertools.product(range(binned.shape[1]), range(bins - 1)):
                        low = binned[rows, f] <= c
                        a, b = g[rows[low], k].sum(), h[rows[low], k].sum()
                        if b >= least and hs - b >= least:
                            gain = 0.5 * (a * a / (b + penalty) + (gs - a) ** 2 / (hs - b + penalty) - gs * gs / (hs + penalty)) - cost
                            if gain > best[0] + 1e-10:
                                best = (gain, f, c)
                if best[1] is None:
                    margin[rows, k] += -rate * gs / (hs + penalty)
                    return
                low = binned[rows, best[1]] <= best[2]
                go(rows[low], level + 1), go(rows[~low], level + 1)

            go(np.arange(len(binned)), 0)
    return margin


@pytest.mark.parametrize("loss", ["logistic", "softmax"])
def test_boosting_equals_a_plain_booster(spark, loss, monkeypatch):
    monkeypatch.setattr(M, "WRITE_ROUNDS", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    kind = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0)
    y = np.eye(3)[kind]
    names = ["a", "b", "c"]
    cuts = [np.array([-1.0, -0.3, 0.0, 0.4, 1.1])] * 4
    df = frame(spark, x, y, names)
    model = M.NewtonBoosting(rounds=5, depth=3, rate=0.4, penalty=1.5, cost=0.05, least_curvature=0.6, bins=6, loss=loss).fit(df, names, cuts=cuts)
    want = model.chance(newton(M.to_bins(x, cuts), y, 5, 3, 6, 0.4, 1.5, 0.05, 0.6, loss))
    assert np.allclose(scores(model.predict(df, names), names), want, atol=1e-9)


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    net = M.SigmoidNetwork(hidden=(5, 4))
    net.sizes, net.middle, net.spread = [3, 5, 4, 2], np.zeros(3), np.ones(3)
    flat = rng.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 2 + 2)
    x, y, w = rng.normal(size=(20, 3)), (rng.random((20, 2)) < 0.4).astype(float), rng.random(20)
    _, grad = net.loss_and_gradient(flat, x, y, w)
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-5
        slope = (net.loss_and_gradient(flat + step, x, y, w)[0] - net.loss_and_gradient(flat - step, x, y, w)[0]) / 2e-5
        assert slope == pytest.approx(grad[k], abs=1e-5)


def test_cuts_and_missing_cells(spark):
    df = spark.createDataFrame([(k, [float(k % 7), 1.0, float("nan")]) for k in range(700)], "id long, features array<double>")
    cuts = M.quantile_cuts(df, 4)
    assert [c.tolist() for c in cuts] == [[1.0, 3.0, 5.0], [1.0], []]
    assert M.to_bins(np.array([[0.0, 1.0, np.nan], [6.0, 2.0, 3.0], [3.0, np.nan, 0.0]]), cuts).tolist() == [[0, 0, 0], [3, 1, 0], [1, 0, 0]]


def test_empty_and_one_sided_inputs(spark):
    empty = spark.createDataFrame([], "id long, features array<double>, labels array<string>")
    one = frame(spark, np.ones((6, 2)), np.ones((6, 1)), ["a"])
    for model in (M.SharedForest(trees=2, depth=2), M.NewtonBoosting(rounds=1, depth=1), M.SigmoidNetwork(hidden=(2,), steps=2)):
        assert model.fit(empty, ["a"]).predict(empty, ["a"]).count() == 0
        got = scores(model.fit(one, ["a"]).predict(one, ["a"]), ["a"])
        assert (got > 0.5).all()


def test_models_are_kept(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    df = frame(spark, x, (x[:, :2] > 0).astype(float), ["a", "b"])
    for model in (M.SharedForest(trees=2, depth=3, features_per_node=2), M.NewtonBoosting(rounds=2, depth=2)):
        before = scores(model.fit(df, ["a", "b"]).predict(df, ["a", "b"]), ["a", "b"])
        M.keep_trees(str(tmp_path / type(model).__name__), model)
        after = M.kept_trees(str(tmp_path / type(model).__name__), type(model))
        assert np.allclose(before, scores(after.predict(df, ["a", "b"]), ["a", "b"]))


def test_sums_in_two_steps(spark, monkeypatch):
    def work(batches):
        n = sum(b.num_rows for b in batches)
        yield (1,), np.array([n, 1.0])
        if n > 10:
            yield (2,), np.array([float(n)])

    got = {r.k: cells_of(r.cells, (-1,)).tolist() for r in array_sums(spark.range(200).repartition(150), work, ["k"]).collect()}
    assert got[1] == [200, 150] and 2 not in got
