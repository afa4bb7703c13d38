import random
from collections import defaultdict

from pyspark.sql import functions as F

from zymolith.llm import line_dedup as L


def brute(texts, least=L.LEAST_DOCUMENTS, depth=L.DEPTH, share=L.FIXED_SHARE):
    space = "\x20\t\n\x0b\x0c\r"

    def tokens(line):
        for c in space:
            line = line.replace(c, " ")
        raw = tuple(w for w in line.split(" ") if w)
        fixed = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in raw)
        return fixed if len(raw) - fixed.count("<*>") >= share * len(raw) else raw

    every = {(d, k): tokens(s) for d, text in enumerate(texts) for k, s in enumerate((text or "").split("\n"))}
    # word for word: short lines, and lines of too many fields for a template
    exact = defaultdict(set)
    for (d, _), t in every.items():
        if any(any(c in "0123456789" for c in w) for w in t if w != "<*>") or len(t) <= depth:
            exact[t].add(d)
    twice = {t for t, docs in exact.items() if t and len(docs) >= least}
    lines = {k: t for k, t in every.items() if len(t) > depth and t not in exact}
    leaf = defaultdict(set)
    for (d, _), t in lines.items():
        leaf[len(t), t[:depth]].add(d)
    lines = {k: t for k, t in lines.items() if len(leaf[len(t), t[:depth]]) >= least}
    seen = defaultdict(set)
    for (d, _), t in lines.items():
        for p, x in enumerate(t):
            seen[len(t), t[:depth], p, x].add(d)
    template, whole = {}, defaultdict(set)
    for (d, k), t in lines.items():
        s = tuple(x if x != "<*>" and (p < depth or len(seen[len(t), t[:depth], p, x]) >= least) else "<*>" for p, x in enumerate(t))
        if sum(x != "<*>" for x in s) >= share * len(s):
            template[d, k] = s
            whole[s].add(d)
    out = []
    for d, text in enumerate(texts):
        all_lines = text.split("\n") if text else []
        keep = [s for k, s in enumerate(all_lines) if len(whole.get(template.get((d, k)), ())) < least and every[d, k] not in twice]
        out.append((len(all_lines), len(all_lines) - len(keep), "\n".join(keep)))
    return out


def some_texts(seed=1, n=80):
    rnd = random.Random(seed)
    forms = ["User {} logged in from {} ok", "Licensed under the Apache License, Version 2.0.", "Posted by {} on {}", "All rights reserved {}", "tiny {}", "a b c", "Les.", "Log in", "{} 17:20 0:1 x", "2024-01-02 3 4", "Read more about {} here now"]
    texts = [None, "", "\n", "\n\nx", "no newline"]
    for _ in range(n):
        lines = [" ".join(f"w{'abcdefgh'[rnd.randrange(8)]}" for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(6))]
        lines += [rnd.choice(forms).format(rnd.choice(["ann", "bob", str(rnd.randrange(10**6))]), rnd.randrange(99)) for _ in range(rnd.randrange(4))]
        rnd.shuffle(lines)
        texts.append(rnd.choice(["\n", "\n\n", " \n"]).join(lines) + rnd.choice(["", "\n"]))
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = some_texts(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit("x")).repartition(3)
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in L.drop_template_lines(docs).collect()}
        want = dict(enumerate(brute(texts)))
        assert {k: (got[k], texts[k]) for k in got if got[k] != want[k]} == {}
        assert sum(w[1] for w in want.values()) > 50


def test_driver_table_against_brute_force(spark, sf_dir):
    from zymolith.llm.queries import op2_line_dedup

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in op2_line_dedup(spark, sf_dir).collect()}
    assert got == {r.doc_id: w[:2] for r, w in zip(rows, want, strict=True)}


def test_long_lines_null_ids_and_empty_tables(spark):
    long = "start of line " + "word " * 50_000
    docs = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long), (3, "short")], "doc_id long, text string")
    assert sorted(r.n_dropped for r in L.drop_template_lines(docs).collect()) == [0, 1, 1, 1, 1]
    short = spark.createDataFrame([(k, f"Share\n\n1 2 3\n{k} {k} {k} x") for k in range(5)], "doc_id long, text string")
    assert {r.kept_text for r in L.drop_template_lines(short).collect()} == {f"\n{k} {k} {k} x" for k in range(5)}
    assert L.drop_template_lines(docs.limit(0)).count() == 0
