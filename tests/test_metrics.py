import math
import random

import pytest
from pyspark.sql import functions as F

from zymolith.operators import metrics as M


def preds(spark, rows):
    return spark.createDataFrame([("k", float(s), int(y)) for y, s in rows], "g string, score double, label int")


def one(df):
    return df.collect()[0]


def test_curve_of_two_points(spark):
    c = {r.threshold: (r.mcc, r.f1) for r in M.mcc_f1_curve(preds(spark, [(1, 0.9), (0, 0.1)]), ["g"]).collect()}
    assert c[0.9] == (1.0, 1.0) and c[0.1][0] == 0.5 and math.isclose(c[0.1][1], 2 / 3)


def numpy_summary(rows, bins=100):
    import numpy as np

    ys, ss = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    t = np.unique(ss)[::-1]
    tp = np.array([(ys[ss >= x]).sum() for x in t], float)
    pp = np.array([(ss >= x).sum() for x in t], float)
    p, n = ys.sum(), (1 - ys).sum()
    den = np.sqrt(p * n * pp * (p + n - pp))
    den[den == 0] = 1
    mcc, f1 = ((n * tp - p * (pp - tp)) / den + 1) / 2, 2 * tp / (pp + p)
    cut, low = int(np.argmax(mcc)), mcc.min()
    unit, means = (mcc.max() - low) / bins, []
    for side in (slice(0, cut + 1), slice(cut + 1, None)):
        m, f = mcc[side], f1[side]
        for i in range(bins):
            inside = (m >= low + (i - 1) * unit) & (m <= low + i * unit)
            if inside.any():
                means.append(np.sqrt((m[inside] - 1) ** 2 + (f[inside] - 1) ** 2).mean())
    best = t[np.argmin(np.sqrt((1 - mcc) ** 2 + (1 - f1) ** 2))]
    return 1 - np.mean(means) / np.sqrt(2), best


@pytest.mark.parametrize("seed,levels", [(1, 5), (2, 40), (3, 10**6)])
def test_against_definitions(spark, seed, levels):
    rnd = random.Random(seed)
    rows = [(y := int(rnd.random() < 0.3), round((rnd.random() + 0.4 * y) * levels) / levels) for _ in range(150)]
    df = preds(spark, rows)
    curve, counts = M.mcc_f1_curve(df, ["g"]), M.counts_curve(df, ["g"])
    want, best = numpy_summary(rows)
    assert math.isclose(one(M.mcc_f1_summary(curve, ["g"])).mccf1, want, abs_tol=1e-9)
    assert one(M.best_threshold(curve, ["g"])).best_threshold == best
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(one(M.roc_auc(counts, ["g"])).auc, auc, abs_tol=1e-12)
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, pp = sum(s >= t for s in pos), sum(s >= t for _, s in rows)
        ap += (tp / len(pos) - last) * tp / pp
        last = tp / len(pos)
    assert math.isclose(one(M.average_precision(counts, ["g"])).ap, ap, abs_tol=1e-12)
    # a monotone map of the scores changes nothing
    again = M.counts_curve(df.withColumn("score", F.exp("score")), ["g"])
    assert math.isclose(one(M.roc_auc(again, ["g"])).auc, auc, abs_tol=1e-12)


def test_grid_follows_linear_interpolation(spark):
    import numpy as np

    rows = [(0, 0.95), (1, 0.9), (0, 0.8), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (1, 0.4), (0, 0.2)]
    thresholds = sorted({s for _, s in rows}, reverse=True)
    total = sum(y for y, _ in rows)
    p = [sum(y for y, s in rows if s >= t) / sum(s >= t for _, s in rows) for t in thresholds]
    r = [sum(y for y, s in rows if s >= t) / total for t in thresholds]
    base = np.linspace(0, 1, 101)
    want = np.interp(base, [0.0, *r], [p[0], *p])
    got = {round(x.recall, 2): x.precision for x in M.pr_grid(M.counts_curve(preds(spark, rows), ["g"]), ["g"]).collect()}
    assert len(got) == 101 and all(math.isclose(got[round(b, 2)], w, abs_tol=1e-9) for b, w in zip(base, want, strict=True))


def test_missing_classes(spark):
    df = preds(spark, [(0, 0.5), (0, 0.4)])
    assert M.eligible(df, ["g"], 1).count() == 0
    with pytest.raises(Exception, match="no positive"):
        M.require_both_classes(df, ["g"]).collect()
    with pytest.raises(Exception, match="no negative"):
        M.require_both_classes(preds(spark, [(1, 0.5)]), ["g"]).collect()


def test_pooled_errors(spark):
    rows = [("m", "a", 0.8), ("m", "a", 1.0), ("m", "b", 0.5), ("m", "b", 0.5)]
    df = spark.createDataFrame(rows, "model string, class string, value double")
    r = one(M.pooled_error(df, ["model"]))
    assert math.isclose(r.mean, 0.7) and math.isclose(r.error, math.sqrt(0.02) / 2)
    r = one(M.pooled_error(df.limit(1), ["model"]))
    assert r.mean == 0.8 and math.isnan(r.error)
    by = {x["class"]: x for x in M.mean_and_sd(df, ["class"], folds=2).collect()}
    assert math.isclose(by["a"].sd, math.sqrt(0.02)) and math.isnan(one(M.mean_and_sd(df, ["class"], folds=3)).sd)


def test_js_is_symmetric_and_bounded(spark):
    mk = lambda d: spark.createDataFrame([("f", k, float(v)) for k, v in d.items()], "f string, k string, weight double")
    a, b = mk({"x": 3, "y": 1}), mk({"y": 2, "z": 5})
    ab, ba = one(M.js_distance(a, b, ["f"], "k")).js, one(M.js_distance(b, a, ["f"], "k")).js
    assert math.isclose(ab, ba) and 0 < ab < math.sqrt(math.log(2))
    assert one(M.js_distance(a, a, ["f"], "k")).js == 0
    assert math.isclose(one(M.js_distance(mk({"x": 1}), mk({"y": 1}), ["f"], "k")).js, math.sqrt(math.log(2)))


def test_shared_negatives_and_running_sums(spark):
    rows = [("plants", "c", 1.0, 1), ("Unknown", "c", 0.5, 0), ("fungi", "c", 0.2, 0)]
    df = spark.createDataFrame(rows, "category string, class string, score double, label int")
    got = sorted((r.name, r.score) for r in M.with_shared_negatives(df).collect())
    assert got == [("fungi_|_c", 0.2), ("fungi_|_c", 0.5), ("plants_|_c", 0.5), ("plants_|_c", 1.0)]
    from zymolith.functions.running import running_sums

    data = spark.createDataFrame([("k", float(x), x) for x in range(500)], "k string, o double, v int")
    out = {int(r.o): r.s for r in running_sums(data, ["k"], "o", {"s": "v"}, buckets=7).collect()}
    assert all(out[x] == sum(range(x, 500)) for x in range(500))


def test_silhouette_of_single_points(spark):
    d = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (0, 2, 4.0), (2, 0, 4.0), (1, 2, 3.0), (2, 1, 3.0)], "i int, j int, d double")
    c = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id int, cluster string")
    got = {r.id: r.silhouette for r in M.silhouette(d, c).collect()}
    assert got == {0: 0.75, 1: (3 - 1) / 3, 2: 0.0}
