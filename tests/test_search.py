import random

import numpy as np
import pytest

from zymolith.operators import search as S

AA = "ACDEFGHIKLMNPQRSTVWY"


def smith_waterman(a, b, sc):
    """Full local alignment with affine gaps, cell by cell."""
    m = sc.matrix()
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = ([[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(2))
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i][j - 1] - sc.gap_open, e[i][j - 1] - sc.gap_more)
            f[i][j] = max(h[i - 1][j] - sc.gap_open, f[i - 1][j] - sc.gap_more)
            h[i][j] = max(0, h[i - 1][j - 1] + int(m[ord(a[i - 1]), ord(b[j - 1])]), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def changed(rnd, s, share):
    out = []
    for c in s:
        x = rnd.random()
        if x < share * 0.8:
            out.append(rnd.choice(AA))
        elif x < share * 0.9:
            out.append(c + rnd.choice(AA))
        elif x >= share:
            out.append(c)
    return "".join(out)


def test_band_equals_the_full_programme():
    rnd = random.Random(1)
    sc = S.Scoring(table={("W", "F"): 3})
    pairs = []
    for _ in range(60):
        a = "".join(rnd.choices(AA, k=rnd.randrange(0, 50)))
        pairs.append((a, changed(rnd, a, 0.3) if rnd.random() < 0.6 else "".join(rnd.choices(AA, k=rnd.randrange(0, 50)))))
    pairs += [("", ""), ("A", ""), ("ACW", "ACF")]
    got = S.local_scores([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], [0] * len(pairs), sc, band=60)
    assert got.tolist() == [smith_waterman(a, b, sc) for a, b in pairs]


def test_decay_solves_its_equation():
    sc = S.Scoring()
    shares = dict(zip(AA, range(1, 21), strict=True))
    x = sc.decay(shares)
    p = np.array([shares[c] for c in AA]) / sum(shares.values())
    at = [ord(c) for c in AA]
    assert (np.outer(p, p) * np.exp(x * sc.matrix()[np.ix_(at, at)])).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        S.Scoring(other=9).decay(shares)


@pytest.mark.parametrize("frequent", [256, 2])
def test_nearest_against_all_pairs(spark, frequent):
    rnd = random.Random(2)
    base = ["".join(rnd.choices(AA, k=rnd.randrange(60, 160))) for _ in range(12)]
    refs = [(100 + k, changed(rnd, s, rnd.choice([0.1, 0.2, 0.3]))) for k, s in enumerate(base * 2)]
    refs += [(200 + k, "MKWVTFISLL" + "".join(rnd.choices(AA, k=40))) for k in range(8)] + [(300, base[0]), (299, base[0]), (301, None), (302, "")]
    asked = [(k, changed(rnd, s, 0.15)) for k, s in enumerate(base)] + [(50, base[0]), (51, base[0]), (52, None), (53, "AC"), (54, "".join(rnd.choices(AA, k=80)))]
    sc = S.Scoring()
    frame = lambda rows: spark.createDataFrame(rows, "id long, sequence string").repartition(3)
    got = {(r.query, r["rank"]): r for r in S.nearest_sequences(frame(asked), frame(refs), 2, scoring=sc, frequent=frequent).collect()}
    hits = 0
    for q, a in asked:
        if not a or len(a) < 4:
            assert (q, 1) not in got
            continue
        scores = sorted((-smith_waterman(a, b, sc), r) for r, b in refs if b)
        if (q, 1) not in got:
            assert q == 54
            continue
        assert (got[q, 1].reference, got[q, 1].score) == (scores[0][1], -scores[0][0])
        hits += (got[q, 2].reference, -got[q, 2].score) == (scores[1][1], scores[1][0]) if (q, 2) in got else 0
    assert hits >= 0.95 * 14
    assert got[50, 1].reference == 299 and got[50, 2].reference == 300 and got[50, 1].expected < 1e-3


def test_same_ids_and_copies(spark):
    rnd = random.Random(3)
    one, two = ("".join(rnd.choices(AA, k=70)) for _ in range(2))
    rows = [(k, one) for k in range(30)] + [(99, changed(rnd, one, 0.1)), (100, two)]
    df = spark.createDataFrame(rows, "id long, sequence string").repartition(4)
    got = {r.query: r.reference for r in S.nearest_sequences(df, df, other_ids=True).collect()}
    assert got == {0: 1, **{k: 0 for k in range(1, 30)}, 99: 0}
    assert S.nearest_sequences(df.limit(0), df).count() == 0 == S.nearest_sequences(df, df.limit(0)).count()


def test_recall_on_distant_relatives(spark):
    """At least 0.95 of the best hits of the full programme among those expected by chance less than once in a thousand."""
    rnd = random.Random(4)
    base = ["".join(rnd.choices(AA, k=120)) for _ in range(40)]
    asked = [(k, changed(rnd, s, 0.35)) for k, s in enumerate(base)]
    refs = [(k, s) for k, s in enumerate(base)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, sequence string")
    got = {r.query: r.reference for r in S.nearest_sequences(frame(asked), frame(refs)).collect()}
    assert sum(got.get(k) == k for k in range(40)) >= 38
