import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zymolith.llm import sentence_pieces as S

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
V = S.MergeVocabulary(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)

TEXTS = st.text(st.one_of(st.sampled_from(list("  \n\t▁aethnorisl.,0129'<>x0A 　 é中日本語😀‍́\x00\x7f")), st.characters(exclude_categories=["Cs"])), max_size=60)


def encoded(texts):
    flat, first = S.BatchEncoder(V).ids(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_encodes_as_the_library(texts):
    assert encoded(texts) == LIBRARY.encode(texts) if texts else encoded(texts) == []


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_agenda_without_cuts(text):
    whole = text.replace(S.SPACE, " ")
    assert (V.agenda(" " + whole) if whole else []) == LIBRARY.encode(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999), st.sampled_from([0, 1, 2, LIBRARY.piece_to_id('▁'), 259, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0xC3, 3 + 32])), max_size=12))
def test_decodes_any_ids_as_the_library(ids):
    got = S.BatchDecoder(V).texts(np.array(ids, np.int32), np.array([0, len(ids)]))
    assert got == [LIBRARY.decode(ids).encode()]


def brute(rows):
    out = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(0)).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_columns_against_the_library(spark):
    rnd = random.Random(3)
    words = ["the", " a", "\n", "ornd.", "中文", "ﬁ", "😀", "▁", "1234", "  ", "\t", "naïve", "<s>", "</s>", "<0x0A>", "<unk>"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randrange(30)))) for k in range(200)]
    rows += [(None, None), (7, ""), (7, ""), (8, " "), (9, "▁"), (10, "\n"), (None, "x"), (11, "x" * 30_000), (12, "ab " * 40_000), (13, " " * 5_000)] + [(14, "same text")] * 3
    assert got(S.encode_pieces(frame(spark, rows), MODEL)) == brute(rows)


def test_ids_and_texts_may_be_kept(spark):
    row = S.encode_pieces(frame(spark, [(1, "two words\n")]), MODEL, keep_ids=True).first()
    assert row.ids == LIBRARY.encode("two words\n", add_bos=True, add_eos=True) and row.decoded == "two words\n"


def test_empty_table(spark):
    assert got(S.encode_pieces(frame(spark, []), MODEL)) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" aethnorislé中👍̀\n")), min_size=1, max_size=90), max_size=8))
def test_agendas_of_many_chunks(chunks):
    flat, size = V.merges.encoded(chunks)
    ends = size.cumsum()
    assert [flat[e - n : e].tolist() for e, n in zip(ends, size, strict=True)] == [V.agenda(c) for c in chunks]


def test_a_difference_from_the_library_is_an_error():
    wrong = S.MergeVocabulary(MODEL)
    wrong.rank = {**wrong.rank, "ea": (-1e9, wrong.rank["ea"][1])}
    with pytest.raises(RuntimeError):
        wrong.checked([" the", " weather"])


def test_sf_texts_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(S.encode_pieces(docs, MODEL)) == brute(rows)
