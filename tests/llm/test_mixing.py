import math
import re
from collections import defaultdict

import pytest

from zymolith.llm import mixing as M
from zymolith.llm.queries import op10_mixing

WORD = re.compile(M.WORD)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            out.update({s: w[s] * level for s in open_})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(docs, out):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(out) == len(docs)
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken >= int(r.target // r.source_size if r.source_size else 0) * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    return want


def test_small_sources_stop_at_three_epochs(spark):
    rows = [(i, "w " * (i % 7), "big") for i in range(400)]
    rows += [(1000 + i, "a b c", "tiny") for i in range(5)] + [(2000 + i, "é ü", None) for i in range(40)]
    rows += [(3000 + i, None, "void") for i in range(3)] + [(1, "w w", "big"), (1, "w w", "big"), (None, "x", "aaa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mix_sources(docs.repartition(3)).collect()
    want = check(docs.collect(), out)
    assert want["tiny"] == 45
    again = M.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_driver_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    source = {r.doc_id: r.source for r in docs}
    rows = op10_mixing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(source)
    check(docs, M.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())


def test_quality_moves_documents_forward(spark):
    rows = [(i, "good text here now" if i % 2 else "b$d t%xt h#re n&w", "s") for i in range(2000)]
    docs = spark.createDataFrame([*rows, *[(5000 + i, "z", "t") for i in range(1)]], "doc_id long, text string, source string")
    out = [r for r in M.mix_sources(docs, weights=(1, 20)).collect() if r.source == "s"]
    full = min(r.taken for r in out)
    extra = [r.doc_id % 2 for r in out if r.taken > full]
    assert not extra or sum(extra) / len(extra) > 0.5


@pytest.mark.parametrize("rows", [[], [(1, "", "s")], [(1, None, None)]])
def test_nothing_to_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.taken for r in M.mix_sources(docs).collect()] == [0] * len(rows)


def test_long_texts_and_clashing_columns(spark):
    """Columns with names of the result or of the work inside are ignored."""
    long = "w " * 200_000
    rows = [(1, long, "a"), (2, "x y", "a"), (3, "", "b"), (4, "z " * 500, "b"), (5, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = plain.selectExpr("*", "'x' as size", "'y' as target", "1 as taken", "2 as k", "3 as turn", "'p' as part", "4 as q", "5 as u")
    got, want = (sorted(map(tuple, M.mix_sources(d.repartition(2)).collect())) for d in (extra, plain))
    assert got == want and [r[2] for r in got] == [200_000, 2, 0, 500, 0]
    check(rows_of(rows), M.mix_sources(extra).collect())


def rows_of(rows):
    from pyspark.sql import Row

    return [Row(doc_id=i, text=t, source=s) for i, t, s in rows]


def test_thousands_of_sources(spark):
    """Sources are numbered and levelled in ranges: many of them, most of which are far below or above their share."""
    rows = [(i, "w " * (1 + i * i % 97 if i % 3 else 2000), f"host-{i % 3000:05d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = check(rows_of(rows), M.mix_sources(docs.repartition(4)).collect())
    assert len(want) == 3000
