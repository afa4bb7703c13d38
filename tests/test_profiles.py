import math
import random

import numpy as np
import pytest

from zymolith.operators import profiles as P


def small(rng, width):
    match = rng.normal(0, 1, (width, 20))
    steps = rng.random((width, 7)) + 0.1
    for a, b in ((0, 3), (3, 5), (5, 7)):
        steps[:, a:b] /= steps[:, a:b].sum(1, keepdims=True)
    return P.Profile("p", match, np.log(steps))


def paths(profile, text):
    """Log odds of every path through the states, one at a time."""
    width, t = len(profile), [dict(zip(P.STEPS, row, strict=True)) for row in profile.steps]
    emit = lambda j, k: profile.match[j, P.LETTERS.index(text[k])] if text[k] in P.LETTERS else 0.0
    out = []

    def go(state, j, k, score):
        """``k``: letters used up to here."""
        if j == width - 1 and state in "md":
            out.append(score)
        if state in "mi" and k < len(text):
            go("i", j, k + 1, score + t[j]["mi" if state == "m" else "ii"])
        if j + 1 < width:
            if k < len(text):
                go("m", j + 1, k + 1, score + t[j][state + "m"] + emit(j + 1, k))
            if state in "md":
                go("d", j + 1, k, score + t[j][state + "d"])

    for start in range(len(text)):
        go("m", 0, start + 1, emit(0, start))
        lead = t[0]["md"]
        for j in range(1, width):  # the first columns deleted
            go("m", j, start + 1, lead + t[j - 1]["dm"] + emit(j, start))
            lead += t[j - 1]["dd"] if j > 1 else t[1 - 1]["dd"]
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_scores_against_all_paths(width):
    rng = np.random.default_rng(width)
    p = small(rng, width)
    texts = ["A", "CW", "ACD", "XAY", "MKTA"]
    whole, best = P.scores(p, texts), P.scores(p, texts, best_path=True)
    for k, text in enumerate(texts):
        every = paths(p, text)
        assert best[k] == pytest.approx(max(every))
        assert whole[k] == pytest.approx(math.log(sum(map(math.exp, every))))
    assert P.scores(p, [""])[0] == -math.inf


def test_profiles_of_classes(spark):
    rnd = random.Random(1)
    base = {"one": "MKVLAWTCDE", "two": "GHHPQRSTNY"}
    rows = []
    for name, s in base.items():
        for _ in range(30):
            text = [c if rnd.random() < 0.85 else rnd.choice(P.LETTERS) for c in s]
            text.insert(5, rnd.choice(P.LETTERS) if rnd.random() < 0.2 else "-")
            if rnd.random() < 0.2:
                text[2] = "."
            rows.append((name, "".join(text)))
    df = spark.createDataFrame([*rows, ("one", None), (None, "AAA"), ("gaps", "---")], "class string, aligned string").repartition(3)
    known = P.profiles(df)
    assert [(p.name, len(p)) for p in known] == [("one", 10), ("two", 10)]
    # counts by plain loops
    one = [t for n, t in rows if n == "one"]
    columns = [k for k in range(11) if sum(t[k] not in "-." for t in one) >= 0.5 * len(one)]
    assert columns == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    steps = np.exp(known[0].steps[1])
    mm = sum(t[1] not in "-." and t[2] not in "-." for t in one)
    md = sum(t[1] not in "-." and t[2] in "-." for t in one)
    assert steps[0] == pytest.approx((mm + 0.5) / (mm + md + 1.5)) and steps[2] == pytest.approx((md + 0.5) / (mm + md + 1.5))
    asked = [(k, "".join(rnd.choices(P.LETTERS, k=7)) + (base["one"] if k % 2 else base["two"]) + "AC") for k in range(20)] + [(99, None), (98, "")]
    got = {(r.id, r["class"]): r.score for r in P.profile_scores(spark.createDataFrame(asked, "id int, sequence string"), known).collect()}
    assert len(got) == 40
    for k in range(20):
        mine, other = ("one", "two") if k % 2 else ("two", "one")
        assert got[k, mine] > 5 > got[k, other]
        assert got[k, mine] == pytest.approx(P.scores(known[0 if mine == "one" else 1], [asked[k][1]])[0])


def test_equal_texts_are_scored_once(spark, monkeypatch):
    known = P.profiles(spark.createDataFrame([("a", "ACDE"), ("b", "WWYY")], "class string, aligned string"))
    rows = spark.createDataFrame([(k, ("ACDE", "WYW", "")[k % 3]) for k in range(90)] + [(99, None)], "id long, sequence string").coalesce(1)
    want = {(p.name, t): P.scores(p, [t])[0] for p in known for t in ("ACDE", "WYW")}
    plain = P.scores
    once = lambda p, texts, best: plain(p, texts, best) if len(texts) == 2 else 1 / 0
    monkeypatch.setattr(P, "scores", once)
    got = P.profile_scores(rows, known).collect()
    assert len(got) == 120 and all(r.score == pytest.approx(want[r["class"], ("ACDE", "WYW")[r.id % 3]]) for r in got)
