import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from zymolith.llm import whitening as W


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(-1)).withColumn("component", F.lit("clash")).repartition(3)


def integers(v, dims):
    x = [math.floor(64 * c) + 1_000_000 for c in v]
    return tuple(x + [1_000_000] * (dims - len(x)))


def brute(rows, most=16):
    """{(id, component): (n, deviation, |whitened|, explained)} by exact fractions up to the covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in kept)
    fit = sorted({integers(v, dims) for _, v in kept})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dims)]
    z = [[n * x[d] - sums[d] for d in range(dims)] for x in fit]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in z), n**3)) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in kept:
        x = integers(v, dims)
        for k in range(min(most, dims)):
            y = sum(float(Fraction(n * x[d] - sums[d], n)) * u[d, k] for d in range(dims)) / math.sqrt(e[k]) if e[k] > 1e-9 else None
            out.append((i, k + 1, n, sum((n * x[d] - sums[d]) ** 2 for d in range(dims)), y if y is None else abs(y), e[k] / e.sum()))
    return sorted(out, key=lambda r: (str(r[0]), r[1], r[3]))


def got(df):
    rows = [(r.vec_id, r.component, r.n, r.deviation, None if r.whitened is None else abs(r.whitened), r.explained) for r in df.collect()]
    return sorted(rows, key=lambda r: (str(r[0]), r[1], r[3]))


def same(a, b):
    assert [r[:4] for r in a] == [r[:4] for r in b]
    for x, y in zip(a, b, strict=True):
        assert (x[4] is None) == (y[4] is None)
        assert x[4] is None or math.isclose(x[4], y[4], rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(x[5], y[5], rel_tol=1e-6, abs_tol=1e-9)


def vectors(n, dims, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, dims)) * np.linspace(0.2, 3, dims) @ rnd.normal(size=(dims, dims))
    return [(k, [float(x) for x in row]) for k, row in enumerate(base)]


def odd_rows(dims):
    nan = float("nan")
    return [(-1, None), (-2, [nan] * dims), (-3, [None] + [0.0] * (dims - 1)), (-4, [float("inf")] * dims)]


def test_against_exact_sums(spark):
    rows = vectors(80, 5)
    rows += [(1000 + k, rows[3][1]) for k in range(60)] + odd_rows(5) + [(None, rows[4][1]), (5, rows[6][1])]
    df = W.whiten(frame(spark, rows))
    same(got(df), brute(rows))
    errors = {r.identity_error for r in df.collect()}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_tiles_of_any_size_agree(spark):
    rows = vectors(50, 7, seed=3)
    want = brute(rows)
    for tile in (1, 2, 3, 7, 100):
        same(got(W.whiten(frame(spark, rows), tile=tile)), want)


def test_more_dimensions_than_components(spark):
    rows = vectors(120, 20, seed=5)
    out = got(W.whiten(frame(spark, rows)))
    same(out, brute(rows))
    assert {r[1] for r in out} == set(range(1, 17))


def test_products_in_blocks(spark):
    rnd = random.Random(2)
    rows = [[rnd.randrange(-(10**6), 10**6) for _ in range(5)] for _ in range(90)]
    fit = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "row long, x array<bigint>").repartition(4)
    x = np.array(rows)
    for block in (1, 7, 1000):
        found = {(r.i, r.j): int(r.total) for r in W.tiled_products(fit, np.zeros(5, np.int64), 2, block).collect()}
        assert found == {(i, j): int((x[:, i] * x[:, j]).sum()) for i in range(5) for j in range(i, 5)}


def test_products_beyond_64_bits():
    a = np.array([[2**40, -(2**50)], [3, 2**55]])
    assert (W.exact_product(a, a) == a.astype(object).T @ a.astype(object)).all()


def test_no_variance_and_lost_rank(spark):
    one = W.whiten(frame(spark, [(k, [0.5, 0.25]) for k in range(4)])).collect()
    assert len(one) == 8 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in one)
    line = W.whiten(frame(spark, [(k, [k * 1.0, k * 2.0, 7.0]) for k in range(10)])).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.component, r.vec_id))] == [False] * 10 + [True] * 20
    assert all(abs(r.identity_error) < 1e-9 for r in line)


def test_lengths_and_empty_tables(spark):
    rows = [(1, [0.5, 1.0, 3.0]), (2, [0.25]), (3, [2.0, 4.0]), (4, [])]
    same(got(W.whiten(frame(spark, rows))), brute(rows))
    assert got(W.whiten(frame(spark, [(1, []), (2, None)]))) == []
    assert got(W.whiten(frame(spark, []))) == []


def test_huge_components(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 1e17])]
    out = W.whiten(frame(spark, rows)).collect()
    assert len(out) == 6 and all(r.deviation == 2**63 - 1 for r in out)
