import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zymolith.llm import decontamination as D

WORD = re.compile(r"[^\W_]+")


def least_edits(item, text):
    above = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        row = [i + 1]
        for j, y in enumerate(text):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above)


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, s in items:
            v = WORD.findall((s or "").lower())
            if not v:
                continue
            e = least_edits(v, w)
            if (len(v) >= 5 and e <= int(0.2 * len(v) + 1e-9)) or (len(v) < 5 and v == w):
                out[d, i] = e
    return out


def edited(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rnd.randrange(len(w))
        what = rnd.randrange(3)
        if what == 0:
            w.insert(k, "zz")
        elif what == 1:
            del w[k]
        else:
            w[k] = "yy"
    return w


def case(seed=1, n=160):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 9, 14, 20, 36, 59])))) for i in range(12)]
    items += [(50, "Tiny item"), (51, None), (52, ""), (53, items[0][1])]
    docs = [(0, None), (1, ""), (2, "tiny, ITEM!"), (3, "a tiny item here"), (4, items[1][1].upper().replace(" ", ",  "))]
    for d in range(10, n):
        text = [word() for _ in range(rnd.randrange(80))]
        if rnd.random() < 0.7:
            v = rnd.choice(items[:12])[1].split()
            k = rnd.randrange(len(text) + 1)
            text[k:k] = edited(rnd, v, rnd.randrange(0, int(0.2 * len(v)) + 3))
        docs.append((d, " ".join(text)))
    return docs, items


def test_recall_and_precision_against_brute_force(spark):
    docs, items = case()
    want = brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.find_contamination(d, b).collect()}
    assert set(got) <= set(want)  # every hit is verified
    assert all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 60
    kept = {r.doc_id for r in D.drop_contaminated(d, b).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in got}
    assert D.drop_contaminated(d, b).columns == d.columns


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = case(2, 60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in D.find_contamination(d, b).collect())
    monkeypatch.setattr(D, "ITEM_BYTES", 900)
    assert [r[:3] for r in sorted(tuple(r) for r in D.find_contamination(d, b).collect())] == [r[:3] for r in one]
    assert D.find_contamination(d, b.limit(0)).count() == 0
    assert D.find_contamination(d.limit(0), b).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_walks_of_close_sequences_meet_again():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 2**62, (200, 36)).astype(np.uint64)
    near = np.stack([D._edited(rng, r, 3) for r in x])
    sizes = np.full(200, 36)
    walk = lambda w: D.cgk(w, sizes, 3, 72)
    agree = (walk(x) == walk(near)).mean((1, 2))
    a, b = walk(x), walk(rng.integers(1, 2**62, (200, 36)).astype(np.uint64))
    assert (agree > 0.4).all() and ((a == b) & (a != 0)).sum() == 0  # padding aside
    assert not (a[0] == a[1]).all()  # tables walk on their own


def test_edit_distance_has_free_ends():
    a = np.array([[1, 2, 3, 4]], np.uint64)
    t = np.array([[9, 9, 1, 2, 8, 3, 4, 9]], np.uint64)
    assert D.edit_distances(a, t).tolist() == [1]


def test_driver_table_against_exact_search(spark, sf_dir):
    from zymolith.llm.queries import op3_decontamination

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    flat = {r.doc_id: " ".join(WORD.findall(r.text.lower())) for r in docs}
    exact = {(d, r.item_id) for r in items for d, t in flat.items() if f" {' '.join(WORD.findall(r.text.lower()))} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, sf_dir).collect()}
    assert exact and exact <= got
    assert find_all_are_close(got, flat, {r.item_id: r.text for r in items})


def find_all_are_close(got, flat, items):
    return all(least_edits(v := WORD.findall(items[i].lower()), flat[d].split()) <= 0.2 * len(v) for d, i in got)


def test_texts_are_split_like_the_brute_force():
    w = D._words(pa.array(["Ab,c D9 é_x", None, "..."]))
    assert np.diff(w.first).tolist() == [5, 0, 0]


def recall_of(words, docs):
    """Share of documents, each with the item under as many random edits as are allowed, in which the item is found."""
    rnd = random.Random(words)
    word = lambda: f"w{rnd.randrange(5000)}"
    item = [word() for _ in range(words)]
    index = D.build_index([0], [" ".join(item)])
    texts = []
    for _ in range(docs):
        text = [word() for _ in range(40)]
        text[20:20] = edited(rnd, item, words // 5)
        texts.append(" ".join(text))
    return len({d for d, *_ in D.find_items(index, pa.array(texts))}) / docs


def test_recall_of_long_items_with_all_allowed_edits():
    assert recall_of(250, 40) >= 0.95
    assert recall_of(400, 40) >= 0.95


def test_recall_of_every_size_and_kind_of_edits():
    """Random edits, and substitutions at even distances, as many as are allowed."""
    rng = np.random.default_rng(4)
    for size in (5, 20, 80, 160, 400):
        words = [f"w{rng.integers(10**9)}" for _ in range(size)]
        index = D.build_index([1], [" ".join(words)])
        texts = []
        for k in range(40):
            w = list(words)
            if k % 2:
                for at in np.unique(np.linspace(0, size - 1, size // 5).round().astype(int)):
                    w[at] = f"x{rng.integers(10**9)}"
            else:
                for _ in range(size // 5):
                    at, what = int(rng.integers(len(w))), int(rng.integers(3))
                    w[at : at + (what > 0)] = [f"x{rng.integers(10**9)}"] * (what < 2)
            around = [" ".join(f"q{rng.integers(10**9)}" for _ in range(30)) for _ in range(2)]
            texts.append(" ".join([around[0], *w, around[1]]))
        found = {d for d, *_ in D.find_items(index, pa.array(texts))}
        assert len(found) >= 0.95 * len(texts), size
