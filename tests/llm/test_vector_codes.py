import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from zymolith.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [min(max(math.floor(4096 * x), -V.LARGEST), V.LARGEST) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (width * parts - len(v)), y) for i, v, y in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(c[p], books[p])[0], []).append(c[p])
            for e, xs in mine.items():
                books[p][e] = [sum(x[d] for x in xs) // len(xs) for d in range(width)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for (i, _, y), c in zip(kept, cut, strict=True):
        got = [near(c[p], books[p]) for p in range(parts)]
        error = min(sum(g[1] for g in got), 2**63 - 1) if all(g[1] < 2**63 for g in got) else None
        out.append((i, y, "".join(f"{g[0]:02x}" for g in got), error))
        total[y] = min(total.get(y, 0) + (error or 0), 2**63 - 1)
    return sorted(((*r, total[r[1]], digest) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("code", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)


def vectors(n, dims=16, seed=1):
    rnd = random.Random(seed)
    hot = [rnd.choice([0.5, -0.25, 0.125]) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else [rnd.randrange(-64, 64) / 64 + rnd.choice([0, 1 / 8192]) for _ in range(dims)]
        rows.append((i, list(v), rnd.choice([0, 1, None])))
    return rows


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(-1, None, 1), (-2, [nan] * 16, 1), (-3, [0.0] * 15 + [None], 2), (-4, [inf] + [0.0] * 15, 2), (None, [0.1] * 16, 0), (None, [0.1] * 16, 0), (3, [0.2] * 16, None), (3, [0.2] * 16, None)]


def as_float(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


def test_against_brute_force(spark):
    rows = vectors(300) + odd_rows()
    assert got(V.vector_codes(frame(spark, rows))) == brute(as_float(rows))


def test_fewer_rows_than_entries_and_equal_vectors(spark):
    rows = [(k, [0.5] * 16, 1) for k in range(5)] + [(9, [0.75] * 16, 1)]
    assert got(V.vector_codes(frame(spark, rows))) == brute(rows)
    assert {r[2] for r in brute(rows)} == {"00" * 8, "05" * 8}


def test_odd_lengths_are_filled_up(spark):
    rows = [(1, [0.5] * 5, 1), (2, [], 1), (3, [0.25] * 11, 2), (4, [0.1] * 9, None)]
    assert got(V.vector_codes(frame(spark, rows))) == brute(as_float(rows))


def test_large_components_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice([-1, 1]) * rnd.randrange(1, 10**5) * 1.5 for _ in range(8)], k % 2) for k in range(40)]
    assert got(V.vector_codes(frame(spark, rows, "double"))) == brute(rows)
    huge = V.vector_codes(frame(spark, [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [1e299] * 8, 1)], "double")).collect()
    assert len(huge) == 3 and all(0 <= r.error <= 2**63 - 1 for r in huge)


def test_no_complete_vector(spark):
    assert got(V.vector_codes(frame(spark, odd_rows()[:4]))) == []
    assert got(V.vector_codes(frame(spark, []))) == []


def test_heavy_parts_by_broadcast_or_shuffle(spark, monkeypatch):
    rows = vectors(120, seed=7)
    heavy, none = V.joined_codes.__defaults__, (1,)
    whole = got(V.vector_codes(frame(spark, rows)))
    V.joined_codes.__defaults__ = none
    try:
        assert got(V.vector_codes(frame(spark, rows))) == whole == brute(as_float(rows))
    finally:
        V.joined_codes.__defaults__ = heavy


def test_other_parameters(spark):
    rows = vectors(60, dims=12, seed=2)
    assert [r[2:4] for r in got(V.vector_codes(frame(spark, rows), parts=3, entries=4, rounds=2))] == [r[2:4] for r in brute(as_float(rows), 3, 4, 2)]
    with pytest.raises(ValueError):
        V.vector_codes(frame(spark, rows), entries=300)
