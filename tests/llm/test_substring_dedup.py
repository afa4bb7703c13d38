import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zymolith.llm import substring_dedup as S
from zymolith.llm.text import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def some_texts(rnd, vocabulary, n):
    base = [str(rnd.randrange(vocabulary)) for _ in range(160)]
    texts = []
    for _ in range(n):
        w = [str(rnd.randrange(vocabulary)) for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.7:
            a, k = rnd.randrange(120), rnd.randrange(len(w) + 1)
            w[k:k] = base[a : a + rnd.randrange(90)]
        texts.append(rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "  ", "\t"]).join(w) + rnd.choice(["", " "]))
    return texts


def test_no_repeated_window_is_ruled_out():
    rnd = random.Random(5)
    for _ in range(150):
        window, rounds = rnd.choice([3, 5, 12, 35]), rnd.choice([0, 1, 3, 6])
        texts = some_texts(rnd, rnd.choice([1, 2, 3, 50]), rnd.randrange(1, 8))
        w = words_of(pa.array(texts))
        flat = [x for t in texts for x in WORD.findall(t)]
        at = S._window_starts(w, window)
        seen = Counter(tuple(flat[i : i + window]) for i in at)
        left = set(S._possible(w, None, window, rounds).tolist())
        assert all(i in left for i in at.tolist() if seen[tuple(flat[i : i + window])] > 1)
        keep = np.array([rnd.random() < 0.5 for _ in flat], bool)
        mine = iter(keep)
        assert S.joined_words(w, keep).to_pylist() == [" ".join(x for x in WORD.findall(t) if next(mine)) for t in texts]


@pytest.mark.parametrize("vocabulary,window", [(1, 5), (2, 8), (400, 35)])
def test_against_brute_force(spark, monkeypatch, vocabulary, window):
    rnd = random.Random(vocabulary)
    texts = some_texts(rnd, vocabulary, 60) + [None, "", "é ü x ß", "a" * 5000 + " b"]
    texts += [texts[3]] * 5
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(docs, window=window).collect()}
    assert got == dict(enumerate(brute(texts, window)))


def test_driver_table_against_brute_force(spark, sf_dir):
    from zymolith.llm.queries import op9_substring_dedup

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = {r.doc_id: b for r, b in zip(rows, brute([r.text for r in rows], 35), strict=True)}
    for r in op9_substring_dedup(spark, sf_dir).collect():
        n, gone, text = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.substring_dedup(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string").withColumn("key", F.lit(1))
    assert [r.n_removed for r in S.substring_dedup(docs, window=3).collect()] == [3, 3]


def test_keys_that_every_pack_has(spark):
    """20,000 keys in all of 60 packs, others in some: the same in one cell and in many, and no group holds all packs."""
    from zymolith.llm import packs as P

    rows = spark.range(60).selectExpr("id AS pack", "explode(sequence(0, 20999)) AS k").where("k < 20000 OR (pack + k) % (k % 50 + 1) = 0")
    rows = rows.selectExpr("k * 7919 AS key", "k % 3 AS check", "pack", "CAST(k AS INT) AS at", "CAST(IF((pack + k) % 11 = 0, 2, 1) AS INT) AS times")
    one, many = ({r.pack: sorted(r.found) for r in P.repeated_elsewhere(rows, c).collect()} for c in (1, 8))
    assert one == many and len(one) == 60
    by = rows.groupBy("key", "check").agg(F.count("*").alias("n"), F.min("times").alias("t")).where("n > 1 AND t = 1").count()
    assert len({k for v in one.values() for k in v}) == by > 20000
    counts = rows.selectExpr("key", "pack", "at", "CAST(times AS LONG) AS n")
    for least in (2, 5, 40):
        a, b = ({r.pack: sorted(r.found) for r in P.in_many_documents(counts, c, least).collect()} for c in (1, 8))
        assert a == b
