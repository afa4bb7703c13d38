import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zymolith.llm import quality as Q


def test_held_out_documents_of_the_driver(spark):
    from zymolith.llm.queries import op6_quality

    d = "/root/testdata/sf0.1"
    rows = op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    y, kept = np.array([r.quality for r in out]), np.array([r.kept for r in out])
    assert (kept == y).mean() > 0.93
    assert kept[y == 1].mean() > 0.97 and (~kept)[y == 0].mean() > 0.7


def brute(rows, model):
    """The same shrinkage, group by group, in plain Python."""
    e = model.chance(Q._in_blocks(pa.array([t or "" for _, _, _, t in rows], pa.large_string())))
    hosts, paths = {}, {}
    for (_, h, p, _), x in zip(rows, e, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, p), []).append(x)
    overall = float(np.mean(e))

    def weight(groups):
        n = sum(len(v) for v, _ in groups)
        gap = sum(len(v) * (np.mean(v) - a) ** 2 for v, a in groups)
        inner = sum(len(v) * a * (1 - a) for v, a in groups) / n
        return min(max(inner / max(gap / n - inner * len(groups) / n, 1e-6) - 1, 1.0), 1e4)

    hw = weight([(v, overall) for v in hosts.values()])
    pw = weight([(v, np.mean(hosts[h])) for (h, _), v in paths.items()])
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    out = []
    for (i, h, p, _), x in zip(rows, e, strict=True):
        hr = (sum(hosts[h]) - x + hw * overall) / (len(hosts[h]) - 1 + hw)
        pr = (sum(paths[h, p]) - x + pw * hr) / (len(paths[h, p]) - 1 + pw)
        out.append((i, round(1 / (1 + math.exp(-(logit(x) + logit(pr) - logit(overall)))), 9)))
    return sorted(out, key=str)


def some_rows(seed=2):
    rnd = random.Random(seed)
    good = lambda: " ".join(f"word{rnd.randrange(500)}" for _ in range(40))
    bad = lambda: "$$ %% | " * 30
    rows = []
    for i in range(300):
        host = rnd.choice(["a", "b", "big", "big", "big", None])
        rows.append((i, host, rnd.choice(["/x", "/y", None]), bad() if rnd.random() < (0.8 if host == "b" else 0.1) else good()))
    return [*rows, (500, "rare", "/z", good()), (501, "a", "/x", None), (None, "a", "/x", ""), (7, "a", "/x", "dup"), (7, "a", "/x", "dup")]


def test_against_plain_python(spark, monkeypatch):
    rows = some_rows()
    model = Q.fit([t for *_, t in rows if t], [int("$" not in t) for *_, t in rows if t])
    docs = spark.createDataFrame(rows, "doc_id long, h string, p string, text string").withColumn("score", F.lit("clash")).repartition(3)
    for limit in (Q.BROADCAST_ROWS, 0):
        monkeypatch.setattr(Q, "BROADCAST_ROWS", limit)
        got = sorted(((r.doc_id, round(r.score, 9)) for r in Q.score_quality(docs, model, F.col("h"), F.col("p")).collect()), key=str)
        want = brute(rows, model)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = some_rows()
    model = Q.fit([t for *_, t in rows if t], [int("$" not in t) for *_, t in rows if t])
    docs = spark.createDataFrame(rows, "doc_id long, h string, p string, text string")
    by = {r.doc_id: r for r in Q.score_quality(docs, model, F.col("h"), F.col("p")).collect()}
    b = next(r for r in by.values() if r.host == "b")
    overall = np.mean([r.evidence for r in by.values()])
    assert abs(by[500].path_rate - overall) < abs(b.path_rate - overall)
    assert Q.score_quality(docs.limit(0), model, F.col("h"), F.col("p")).count() == 0
    assert Q.fit([], []).chance(np.zeros((1, 12)))[0] == 0.5
