import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from zymolith.llm import exact_dedup as E


def brute(rows):
    same = {}
    for i, t in rows:
        same.setdefault(t or "", []).append(i)
    out, stayed = [], set()
    for i, t in rows:
        ids = [x for x in same[t or ""] if x is not None]
        keep = max(ids, default=None)
        first = i == keep and (t or "") not in stayed
        if first:
            stayed.add(t or "")
        out.append((i, keep, len(same[t or ""]), first, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def rows_of(n=300):
    rnd = random.Random(3)
    texts = ["a", "A", "a ", "", None, "é", "é", "x" * 100_000, "x" * 99_999 + "y"] + [str(k) for k in range(60)]
    rows = [(i, rnd.choice(texts)) for i in range(n)]
    rows += [(1000 + i, "hot") for i in range(n // 2)] + [(7, "twice"), (7, "twice"), (None, "no id"), (None, "a"), (None, "both"), (None, "both"), (2000, "hot"), (2000, "hot")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).repartition(3)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_against_brute_force(spark):
    rows = rows_of()
    assert got(E.exact_dedup(frame(spark, rows))) == brute(rows)


def test_chains_of_a_weak_hash_and_split_buckets(spark):
    rows = rows_of()
    weak = F.pmod(F.xxhash64("__zy_text"), F.lit(5)).cast("long")
    assert got(E.exact_dedup(frame(spark, rows), text_hash=weak)) == brute(rows)
    assert got(E.exact_dedup(frame(spark, rows), capacity=2)) == brute(rows)


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(1000).select(F.xxhash64("id").alias("__zy_hash"))
    cells, depth = E.directory(entries, capacity=32)
    rows = cells.collect()
    by = Counter()
    for r in entries.select(F.shiftrightunsigned("__zy_hash", 64 - depth).alias("c")).collect():
        by[next(x.bucket for x in rows if x.cell == r.c)] += 1
    assert max(by.values()) <= 32 and len({r.bucket for r in rows}) > 20
    assert len({r.local_depth for r in rows}) > 1  # only overfull buckets were split
    for r in rows:  # a bucket is a range of cells
        assert r.bucket <= r.cell < r.bucket + 2 ** (depth - r.local_depth)


def test_shuffled_path_agrees(spark, monkeypatch):
    rows = rows_of()
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    assert got(E.exact_dedup(frame(spark, rows))) == brute(rows)


def test_empty_table_and_kept_rows(spark):
    assert E.exact_dedup(frame(spark, [])).count() == 0
    rows = [(i, "same" if i % 3 else str(i)) for i in range(30)]
    docs = frame(spark, rows)
    kept = E.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(30) if i % 3 == 0] + [29])
    rows = rows_of()
    kept = E.drop_exact_copies(frame(spark, rows)).collect()
    want = {t or "": max((i for i, u in rows if (u or "") == (t or "") and i is not None), default=None) for _, t in rows}
    assert len(kept) == len(want) and {r.text or "": r.doc_id for r in kept} == want


def test_links_decide(spark):
    """What stays and the sizes are read from the bucket that the directory names, and from nowhere else."""
    rows = [(i, "same" if i % 3 else str(i)) for i in range(30)]
    index = E.Index(frame(spark, rows), "doc_id", "text", 2, None)
    assert index.cells.select("bucket").distinct().count() > 4
    assert [(r.link, r[E._KEEP], r[E._N]) for r in index.links.collect()] == [(1, 29, 20)]
    index.near = index.cells.select("cell", F.lit(-1).cast("long").alias("bucket"))
    assert {r[E._N] for r in index.linked(index.rows).collect()} == {1}
