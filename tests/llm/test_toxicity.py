import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from zymolith.llm import toxicity as T


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    p = y.sum()
    return (rank[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p))


def scored(model, texts):
    doc, term = (np.concatenate(x) for x in zip(*T._flat(texts, T.BITS), strict=True))
    return T._sigmoid(model.logits(doc, term, len(texts)))


def test_pairs_that_single_weights_miss():
    """Toxic only where an insult meets a group: either word alone is harmless."""
    rnd = random.Random(3)
    texts, labels = [], []
    for _ in range(4000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join([f"w{rnd.randrange(500)}" for _ in range(15)] + ["insultword"] * a + ["groupname"] * b))
        labels.append(int(a and b))
    model = T.fit(texts, labels)
    score = scored(model, ["w1 w2 insultword w3", "w1 w2 groupname", "w1 w2", "w5 insultword w6 groupname"])
    assert score[3] > 0.7 and max(score[:3]) < 0.7


def test_either_word_alone_is_toxic_both_are_not():
    """Neither word tells the classes apart by itself."""
    rnd = random.Random(7)
    texts, labels = [], []
    for _ in range(4000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join([f"w{rnd.randrange(500)}" for _ in range(15)] + ["oneword"] * a + ["otherword"] * b))
        labels.append(int(a != b))
    score = scored(T.fit(texts, labels), ["w1 oneword w3", "w2 otherword", "w5 oneword w6 otherword", "w8 w9"])
    assert min(score[:2]) > 0.7 > max(score[2:])


def test_rare_group_word(spark):
    """A group's name in 1 % of the rows, a tenth of them toxic; toxic only where a common word meets it."""
    rnd = random.Random(9)
    rows = []
    for k in range(8000):
        words = [f"w{rnd.randrange(300)}" for _ in range(20)]
        kind, toxic = rnd.random(), 0
        if kind < 0.05:  # plainly toxic
            words, toxic = [*words, f"slur{rnd.randrange(3)}"], 1
        elif kind < 0.30:  # a word that is harmless alone
            words.append("dirty")
        elif kind < 0.32:
            words.append("groupname")
        elif kind < 0.335:
            words, toxic = [*words, "dirty", "groupname"], 1
        rows.append((k, " ".join(words), toxic))
    model = T.fit([t for _, t, _ in rows], [y for *_, y in rows])
    score = scored(model, ["w1 dirty w2", "w3 groupname w4", "w1 dirty groupname w2", "w1 w2 w3"])
    assert score[2] > 0.7 > max(score[0], score[1], score[3])
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = T.fit_on(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    score = scored(model, ["w1 dirty w2", "w3 groupname w4", "w1 dirty groupname w2", "w1 w2 w3"])
    assert score[2] > 0.7 > max(score[0], score[1], score[3])


def test_scores_against_the_plain_formula():
    """Logits by the definition, term by term and pair by pair."""
    rng = np.random.default_rng(3)
    model = T.FactorizationMachine(-1.5, rng.normal(0, 1, 1 << T.BITS), rng.normal(0, 0.3, (1 << T.BITS, T.RANK)))
    texts = ["Bad thing, BAD; things", "", "one two three longerword longerwords", "x" * 30]
    from zymolith.llm.linear_terms import hashed_terms
    import pyarrow as pa

    for text, score in zip(texts, scored(model, texts), strict=True):
        _, terms = hashed_terms(pa.array([text]), T.BITS)
        terms = sorted(set(terms.tolist()))
        z = model.bias + sum(model.linear[i] for i in terms)
        z += sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(terms) for j in terms[k + 1 :])
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_documents_of_the_driver(spark):
    from zymolith.llm.queries import op7_toxicity

    d = "/root/testdata/sf0.1"
    rows = op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    y, s, p = (np.array([r[k] for r in out]) for k in ("toxic", "score", "predicted"))
    assert auc(s, y) > 0.93
    assert (p & y).sum() / p.sum() > 0.85 and (p & y).sum() / y.sum() > 0.75
    assert (p == (s >= 0.7)).all() and s.min() >= 0 and s.max() <= 1


def test_whole_texts_nulls_and_order(spark):
    model = T.fit(["bad thing"] * 300 + ["good thing"] * 300, [1] * 300 + [0] * 300)
    rows = [(1, None), (2, ""), (3, "x " * 60_000 + "bad"), (None, "bad"), (5, "good"), (5, "good"), (6, "BAD!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in T.score_toxicity(docs, model).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == 7 and by[1][2] == by[2][2] and by[None][1] is True
    assert by[3][2] > by[2][2] and by[6][2] == by[None][2] > 0.7 > by[5][2]
    assert T.score_toxicity(docs.limit(0), model).count() == 0
    again = [tuple(r) for r in T.score_toxicity(docs.repartition(3), model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("common t"), F.col("id") % 2).alias("text"))
    y = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    wrong = y.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit_on(docs, y), T.fit_on(docs, wrong)
    assert a.bias == b.bias and (a.linear == b.linear).all()


def test_one_class_or_no_labels():
    for texts, labels in (([], []), (["a"] * 5, [0] * 5)):
        assert (scored(T.fit(texts, labels), ["a", ""]) < 0.7).all()


def test_memory_of_long_batches():
    """Terms, scores and pairs of a batch are taken a small block of texts at a time."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, 300)) for _ in range(1200)]
    model = T.FactorizationMachine(0.0, rng.normal(size=1 << T.BITS), np.zeros((1 << T.BITS, 1)))
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, ""])], ["text"])

    def peak(work):
        tracemalloc.start()
        try:
            kept = work()
            return tracemalloc.get_traced_memory()[1] / 1e6, kept
        finally:
            tracemalloc.stop()

    most, scores = peak(lambda: [z for _, z in T._scored(model, batch, 0)])
    assert most < 10 and sum(map(len, scores)) == 1202 and scores[-1][-1] == scores[-1][-2] == 0.5
    most, _ = peak(lambda: sum(len(k) for _, k in T._near_pairs(batch.column(0).slice(0, 1200), T.BITS, np.ones(1 << T.BITS, bool))))
    assert most < 20
