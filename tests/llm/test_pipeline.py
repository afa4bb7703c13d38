import math
from collections import defaultdict

import numpy as np

import corpus_pipeline
from zymolith.llm import toxicity as T

from .test_decontamination import brute as contaminated
from .test_minhash import brute_classes
from .test_mixing import WORD, brute_targets


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    model = T.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ids = sorted(rows)
    doc, term = (np.concatenate(x) for x in zip(*T._flat([rows[i] for i in ids], T.BITS), strict=True))
    score = T._sigmoid(model.logits(doc, term, len(ids)))
    want = {}
    left = {i for i, s in zip(ids, score, strict=True) if s < 0.7}
    want["toxicity"] = left
    last = {}
    for i in sorted(left):
        last[rows[i]] = i
    left = set(last.values())
    want["exact_dedup"] = left
    left = {c[0] for c in brute_classes([(i, rows[i]) for i in sorted(left)])}
    want["near_dedup"] = left
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {d for d, _ in contaminated([(i, rows[i]) for i in sorted(left) if len(rows[i]) < 6000], items)}
    big = {i for i in left if len(rows[i]) >= 6000}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
        got = {r.doc_id for r in now.select("doc_id").collect()}
        if name in want:
            assert got == want[name], name
        else:
            assert got - big == left - hits - big and got <= left
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == got
    sizes, taken = defaultdict(int), defaultdict(int)
    for i in got:
        sizes[source[i]] += len(WORD.findall(rows[i]))
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 1 and math.isclose(next(r.target for r in out if r.source == s), t)


def test_stage_names_and_registration():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_empty_and_odd_documents_pass_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "some words that are here", "en", None, 1, "y"), (4, "w " * 50_000, "en", "s", 1, "z"), (5, "plain clean text", "en", "s", 3, "z")]
    for k, kept in enumerate((rows, [])):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(kept, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] * len(kept), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "an item that is in no text at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        # nulls and empty texts are exact copies of each other
        assert sorted(str(r.doc_id) for r in out) == (["2", "4", "5", "None"] if kept else [])
