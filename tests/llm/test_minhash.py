import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zymolith.llm import components as C
from zymolith.llm import minhash as N
from zymolith.llm.components import components
from zymolith.llm.text import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        bags.setdefault(frozenset(bag(t).items()), []).append(i)
    keys = list(bags)
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(keys)):
        for y in range(x):
            if keys[x] and keys[y] and overlap(Counter(dict(keys[x])), Counter(dict(keys[y]))) >= 0.8:
                parent[root(x)] = root(y)
    out = {}
    for x, k in enumerate(keys):
        out.setdefault(root(x), []).extend(bags[k])
    return sorted(tuple(sorted(v)) for v in out.values())


def changed(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
    return " ".join(w)


def families(rnd, n=8, copies=12):
    rows, i = [], 0
    for f in range(n):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([30, 80, 300]))]
        for _ in range(copies):
            rows.append((i, changed(rnd, base, rnd.choice([0, 0, 1, 2, 3]))))
            i += 1
    rows += [(i + k, t) for k, t in enumerate([None, "", " ", "one", "one", "two words", "a a a a a a a", "a a a a a a a a"])]
    return rows


def classes(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.class_id, []).append(r)
    for k, rows in got.items():
        assert all(r.class_size == len(rows) for r in rows) and k == min(r.doc_id for r in rows)
        assert [r.doc_id for r in rows if r.kept] == [k]
    return sorted(tuple(sorted(r.doc_id for r in rows)) for rows in got.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)


def test_signatures_agree_as_often_as_multisets_overlap():
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(20)}" for _ in range(200)] * 2
    texts = [" ".join(base), changed(rnd, base, 8), " ".join(base[:300]), " ".join(base * 3), "a " * 40, "a " * 55, "a b c d e f"]
    doc, sh, count = N.multisets(words_of(pa.array(texts)))
    sig = N.bag_minhash(doc, sh, count, len(texts), 4096)
    assert np.isfinite(sig).all()
    for a in range(len(texts)):
        for b in range(a):
            j = overlap(bag(texts[a]), bag(texts[b]))
            assert abs((sig[a] == sig[b]).mean() - j) < 5 * np.sqrt(j * (1 - j) / 4096) + 1e-9
    one = np.flatnonzero(doc == 1)  # a signature does not depend on the other texts of the block
    alone = N.bag_minhash(np.zeros(len(one), np.int64), sh[one], count[one], 1, 4096)
    assert (alone[0] == sig[1]).all()


@pytest.mark.parametrize("block", [N.BLOCK_SHINGLES, 700])
def test_against_brute_force(spark, block):
    rows = families(random.Random(4))
    assert classes(N.near_duplicates(frame(spark, rows), block_shingles=block)) == brute_classes(rows)


def test_driver_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    from zymolith.llm.queries import op4_minhash_dedup

    assert classes(op4_minhash_dedup(spark, sf_dir)) == brute_classes(rows)


def test_shuffled_path_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    rows = families(random.Random(6), n=3)
    assert classes(N.near_duplicates(frame(spark, rows))) == brute_classes(rows)
    odd = frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words all of them here")])
    assert sorted((r.doc_id or -1, r.class_id, r.class_size) for r in N.near_duplicates(odd).collect()) == [(-1, 3, 3), (3, 3, 1), (3, 3, 3), (3, 3, 3)]
    assert N.near_duplicates(frame(spark, [])).count() == 0
    assert [r.doc_id for r in N.drop_near_copies(frame(spark, [(1, "x"), (2, "x"), (5, "y")])).orderBy("doc_id").collect()] == [1, 5]


def test_stage_keeps_one_row_of_each_class_for_any_ids(spark):
    rows = families(random.Random(12), n=5, copies=6)
    near = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    for ids in (lambda k: None, lambda k: k % 3, lambda k: None if k % 3 == 0 else k, lambda k: k):
        table = spark.createDataFrame([(ids(k), t, k) for k, (_, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(3)
        kept = N.drop_near_copies(table)
        assert kept.columns == ["doc_id", "text", "k"]
        assert sorted(sum(r.k in c for r in kept.collect()) for c in near) == [1] * len(near)
    # id 5 is a copy in one class and the kept row of another
    table = frame(spark, [(1, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (9, "g h i j k l"), (5, "alone here")])
    assert sorted(tuple(r)[:2] for r in N.drop_near_copies(table).select("doc_id", "text").collect()) == [(1, "a b c d e f"), (5, "alone here"), (5, "g h i j k l")]


def test_one_id_for_many_texts(spark):
    """A third of all rows share an id, with texts that are near copies of others: nothing multiplies, no link is lost."""
    rows = families(random.Random(9), n=4, copies=9)
    shared = [(None if k % 3 == 0 else i, t) for k, (i, t) in enumerate(rows)]
    want = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    sizes = {k: len(c) for c in want for k in c}
    got = N.near_duplicates(frame(spark, shared), block_shingles=300).collect()
    assert sorted(r.class_size for r in got) == sorted(sizes.values())


def test_large_buckets_lose_no_link(spark):
    """A chain: each text is linked to its neighbours only, all in common buckets, cut into many blocks."""
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for _ in range(1):
            words[rnd.randrange(100)] = f"x{i}"
    assert classes(N.near_duplicates(frame(spark, rows), block_shingles=400)) == brute_classes(rows)


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components_of_a_long_path(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL_EDGES", small)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
