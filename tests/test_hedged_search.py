import numpy as np

from zymolith.operators import learning as L

SPACE = {"rate": L.Dimension(1e-4, 1.0, logarithmic=True), "depth": L.Dimension(1, 12, whole=True), "kind": L.Dimension(values=("x", "y", "z"))}


def loss(p):
    return (np.log10(p["rate"]) + 1.7) ** 2 + 0.1 * (p["depth"] - 7) ** 2 + (p["kind"] != "y")


def test_beats_random_points_at_equal_trials():
    ours, random = [], []
    for seed in range(6):
        seen = []
        best, value = L.hedged_search(SPACE, 25, lambda ps, s=seen: s.extend(ps) or [loss(p) for p in ps], {"rate": 1.0, "depth": 1, "kind": "x"}, seed=seed)
        assert len(seen) == 25 and seen[0] == {"rate": 1.0, "depth": 1, "kind": "x"} and value == min(map(loss, seen)) == loss(best)
        assert all(1e-4 <= p["rate"] <= 1 and p["depth"] in range(1, 13) and p["kind"] in "xyz" for p in seen)
        ours.append(value)
        rng = np.random.default_rng(seed)
        random.append(min(loss({n: d.at(rng.random(d.width()).tolist()) for n, d in SPACE.items()}) for _ in range(25)))
    assert np.mean(ours) < 0.5 * np.mean(random) and np.median(ours) < 0.1


def test_batches_have_different_points():
    sizes = []
    L.hedged_search(SPACE, 17, lambda ps: sizes.append(len({tuple(p.values()) for p in ps})) or [loss(p) for p in ps], first=4, batch=4)
    assert sizes == [4, 4, 4, 4, 1]


def test_folds_of_several_sets_are_one_job(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k % 3, float(x), float(3 * x + rng.normal(0, 0.1))) for k, x in enumerate(rng.random(90))], "fold int, x double, y double")

    def fit_and_score(params, train, test):
        slope = (train.x * train.y).sum() / ((train.x**2).sum() + params["penalty"])
        return ((test.y - slope * test.x) ** 2).mean()

    losses = L.grouped_fold_losses(rows, fit_and_score)
    sets = [{"penalty": 0.0}, {"penalty": 50.0}]
    pdf = rows.toPandas()
    want = [np.mean([fit_and_score(p, pdf[pdf.fold != f], pdf[pdf.fold == f]) for f in range(3)]) for p in sets]
    assert np.allclose(losses(sets), want) and want[0] < want[1]
    best, _ = L.hedged_search({"penalty": L.Dimension(1e-3, 100.0, logarithmic=True)}, 6, losses, first=3, batch=3)
    assert best["penalty"] < 10
