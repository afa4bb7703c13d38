"""Hashed terms of texts and bounded samples of labelled rows, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import empty_text, written
from .text import NOT_ALNUM, U64, hash_ranges, salted, words_of

#: Bytes of the word beginnings that are terms of their own.
PREFIXES = (4, 5, 6)


def hashed_terms(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs of whole texts, in order of document.

    Terms are lower-cased runs of letters and digits and their beginnings,
    hashed to ``bits`` bits.
    """
    w = words_of(pc.utf8_lower(texts.cast(pa.large_string())), NOT_ALNUM)
    owner = w.owner().astype(U64)
    keep = U64(64 - bits)
    terms = [w.hash >> keep]
    owners = [owner]
    for k, size in enumerate(PREFIXES):
        longer = (w.end - w.start) > size
        head = hash_ranges(w.data, w.start[longer], w.start[longer] + size)
        terms.append(salted(head, k) >> keep)
        owners.append(owner[longer])
    pairs = np.unique((np.concatenate(owners) << U64(bits)) | np.concatenate(terms))
    return (pairs >> U64(bits)).astype(np.int64), (pairs & U64((1 << bits) - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document may not be learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (turn, part, label, text) of at most ``most`` labelled rows that are not held out, chosen by a hash of the id.

    ``turn`` is a hash that orders the rows, ``part`` a number from 0 to 4 for each.
    Only the chosen ids, a bounded number, are matched with the texts; of rows that
    share an id one is taken.  Null texts are empty; rows without a label are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    return written(rows.select(F.xxhash64(F.lit(12), "doc_id").alias("turn"), F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(5)).cast("int").alias("part"), "label", "text"), "sample")
