"""Toxicity scores of a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a
text, so a pair of terms can weigh more, or less, than its two terms alone.

Inputs are the terms that tell the classes apart, and the terms that only do so
in pairs: pairs of words that stand near each other are counted in the labelled
rows, and where a pair tells the classes apart more clearly than either of its
words, both become inputs, however neutral each is alone.

The model is fitted on the driver from a bounded sample of labelled rows, of
which it gets term numbers and counts of pairs, and has a fixed size (2**bits
terms times 1 + rank numbers), which bounds the broadcast.  Every text is scored
whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear_terms import hashed_terms, held_out, labelled_sample
from .shared import empty_text
from .text import NOT_ALNUM, U64, blocks, mix, words_of

BITS = 18
RANK = 4
#: At most so many labelled rows are learnt from.
SAMPLE_ROWS = 8_000
#: A score from here on predicts toxicity.
THRESHOLD = 0.7
#: Words of a pair are at most so far apart.
SPAN = 8
#: Rows, half of either class, in which candidates of pairs are looked for; and rows that a pair's word must be in.
PAIR_ROWS = 4_000
LEAST_ROWS = 4
#: A pair's z statistic, and how far it must exceed those of its words.
PAIR_Z, PAIR_MARGIN = 6.0, 2.0
#: Bytes of text that a task has in terms or pairs at a time, which take up to fifty times as much.
_BLOCK = 1 << 17
_CELL_BITS = 24


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(doc, self.linear[term], n) + self.bias
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _flat(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, term) pairs, a block of texts at a time."""
    arr = pa.array(texts, pa.large_string())
    for a, b in blocks(arr, _BLOCK):
        d, t = hashed_terms(arr.slice(a, b - a), bits)
        yield d + a, t


def _near_pairs(texts: pa.Array, bits: int, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (document, pair of words) of a block of texts at a time; a pair is lower term, higher term."""
    for start, stop in blocks(texts, _BLOCK):
        w = words_of(pc.utf8_lower(texts.slice(start, stop - start).cast(pa.large_string())), NOT_ALNUM)
        t, owner = w.hash >> U64(64 - bits), w.owner()
        ok, found = frequent[t], []
        for off in range(1, SPAN + 1):
            at = np.flatnonzero(ok[:-off] & ok[off:] & (owner[:-off] == owner[off:]) & (t[:-off] != t[off:]))
            a, b = t[at], t[at + off]
            found.append((owner[at].astype(U64) << U64(2 * bits)) | (np.minimum(a, b) << U64(bits)) | np.maximum(a, b))
        both = np.unique(np.concatenate(found))
        yield (both >> U64(2 * bits)).astype(np.int64) + start, both & U64((1 << 2 * bits) - 1)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, positive rows) of parts of the same."""
    if not parts:
        return np.zeros(0, U64), np.zeros(0), np.zeros(0)
    keys, n, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, slot = np.unique(keys, return_inverse=True)
    return names, np.bincount(slot, n, len(names)), np.bincount(slot, p, len(names))


def _counted(doc: np.ndarray, pair: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _summed([(pair, np.ones(len(pair)), y[doc])])


def _candidates(keys: np.ndarray, n: np.ndarray, p: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """Pairs worth an exact count: a few positive rows more than chance, or common ones among negative rows only."""
    z = _z(n, p, positives, negatives)
    more = (p >= LEAST_ROWS) & (z >= 2)
    less = (n - p >= max(LEAST_ROWS, 0.05 * negatives)) & (z <= -2)
    return keys[more | less]


def fit(texts: list[str], labels: list[int], bits: int = BITS, seed: int = 5, **more) -> FactorizationMachine:
    """The same model from texts at hand."""
    arr, y = pa.array(texts, pa.large_string()), np.asarray(labels, float)
    n = len(y)
    part = np.random.default_rng(seed).random(n) < 0.2
    if not n or y.min() == y.max():
        return fit_terms(np.zeros(0, np.int64), np.zeros(0, np.int64), y, part, None, bits, seed=seed, **more)
    doc, term = (np.concatenate(x) for x in zip(*_flat(texts, bits), strict=True))
    frequent = np.bincount(term[~part[doc]], minlength=1 << bits) >= LEAST_ROWS
    learn = [np.flatnonzero(~part & (y == c))[: PAIR_ROWS // 2] for c in (1, 0)]
    rows = np.concatenate([learn[0], learn[1][: max(1, len(learn[0]))]])
    some = _summed([_counted(d, k, y[rows]) for d, k in _near_pairs(arr.take(pa.array(rows)), bits, frequent)])
    wanted = _candidates(*some, y[rows].sum(), (1 - y[rows]).sum())
    parts = []
    for d, k in _near_pairs(arr, bits, frequent):
        keep = ~part[d] & np.isin(k, wanted)
        parts.append(_counted(d[keep], k[keep], y))
    return fit_terms(doc, term, y, part, _summed(parts), bits, seed=seed, **more)


def fit_terms(doc: np.ndarray, term: np.ndarray, y: np.ndarray, part: np.ndarray, pairs: tuple | None, bits: int = BITS, rank: int = RANK, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> FactorizationMachine:
    """Fits by AdaGrad over small batches.

    ``doc`` and ``term`` are the distinct terms of each row, in order of row;
    ``part`` marks the fifth of the rows that is left out of the fit; ``pairs``:
    counts of pairs in the other rows.  A term's input is the strength with which
    its presence, or that of a pair it is in, tells the classes apart (how far the z
    statistic exceeds 3, at most 1); terms below that stay at zero, so common words
    add no noise to long texts.  On the rows left out the logit is shifted so that
    the cut with the best F1 falls on THRESHOLD.
    """
    rng = np.random.default_rng(seed)
    size = 1 << bits
    w, v, b = np.zeros(size), np.zeros((size, rank)), 0.0
    n = len(y)
    if not n or y.min() == y.max():
        base = (y.sum() + 1) / (n + 20) if n else 0.05
        return FactorizationMachine(float(np.log(base / (1 - base))), w, v)
    learn, check = np.flatnonzero(~part), np.flatnonzero(part)
    here = ~part[doc]
    total, positive = np.bincount(term[here], minlength=size), np.bincount(term[here], y[doc[here]], size)
    p, q = y[~part].sum(), (1 - y[~part]).sum()
    alone = _z(total, positive, p, q)
    strength = np.clip((np.abs(alone) - 3) / 5, 0, 1)
    if pairs is not None:
        keys, rows, hits = pairs
        z, first, second = np.abs(_z(rows, hits, p, q)), (keys >> U64(bits)).astype(np.int64), (keys & U64(size - 1)).astype(np.int64)
        clear = (z >= PAIR_Z) & (z >= np.maximum(np.abs(alone[first]), np.abs(alone[second])) + PAIR_MARGIN)
        for ends in (first, second):
            np.maximum.at(strength, ends[clear], np.clip((z[clear] - 3) / 5, 0, 1))
    keep = strength[term] > 0
    doc, term = doc[keep], term[keep]
    v[strength > 0] = rng.normal(0, 0.05, (int((strength > 0).sum()), rank))
    first = np.searchsorted(doc, np.arange(n + 1))
    gw, gv, gb = np.full(size, 1e-4), np.full((size, rank), 1e-4), 1e-4
    weight = np.where(y > 0, min(4.0, (n - y.sum()) / y.sum()), 1.0)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
            sizes = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            own, t = np.repeat(np.arange(len(rows)), sizes), term[at]
            used, slot = np.unique(t, return_inverse=True)
            x, wv = strength[t], v[used]
            sums = np.stack([np.bincount(own, wv[slot, f] * x, len(rows)) for f in range(rank)], 1)
            squares = np.bincount(own, (wv * wv).sum(1)[slot] * x * x, len(rows))
            z = np.bincount(own, w[used][slot] * x, len(rows)) + b + 0.5 * ((sums**2).sum(1) - squares)
            err = (_sigmoid(z) - y[rows]) * weight[rows] / len(rows)
            e = err[own] * x
            g = np.bincount(slot, e, len(used)) + decay * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            for f in range(rank):
                g = np.bincount(slot, e * (sums[own, f] - wv[slot, f] * x), len(used)) + decay * wv[:, f]
                gv[used, f] += g * g
                v[used, f] -= 0.2 * rate * g / np.sqrt(gv[used, f])
            g = err.sum()
            gb += g * g
            b -= rate * g / np.sqrt(gb)
    w, v = w * strength, v * strength[:, None]
    model = FactorizationMachine(float(b), w, v)
    rows = check if len(check) >= 50 and 5 <= y[check].sum() < len(check) else np.arange(n)
    z = model.logits(doc, term, n)[rows]
    model.bias += float(np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(z, y[rows]))
    return model


def _z(total: np.ndarray, positive: np.ndarray, p: float, n: float) -> np.ndarray:
    """How clearly presence differs between ``p`` positive and ``n`` negative rows."""
    if not p or not n:
        return np.zeros(len(total))
    share = (total + 1) / (p + n)
    return (positive / p - (total - positive) / n) / np.sqrt(share * (1 / p + 1 / n))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among cuts whose F1 is near the best."""
    order = np.argsort(-z)
    z, hit = z[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    good = np.flatnonzero(f1[:-1] >= f1.max() - 0.005) if len(z) > 1 else np.zeros(0, int)
    if not len(good):
        return float(z[-1]) - 1
    at = good[np.argmax(z[good] - z[good + 1])]
    return float((z[at] + z[at + 1]) / 2)


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """The model of at most ``sample_rows`` labelled rows that are not held out.

    Texts stay on the executors: the driver gets each row's terms, of which there
    are 2**BITS at most, and counts of pairs.  Null texts are empty ones; without
    labels of both classes the score is the smoothed base rate everywhere.
    """
    sample = labelled_sample(docs, labels, "toxic", sample_rows, id_col, text_col)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term = (np.concatenate(x) for x in zip(*((d + a, t) for a, b in blocks(batch.column(3), _BLOCK) for d, t in [hashed_terms(batch.column(3).slice(a, b - a), BITS)]), strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["turn", "part", "label", "terms"])

    rows = sample.mapInArrow(terms, "turn long, part int, label int, terms array<int>").toArrow().sort_by("turn")
    y, part = rows["label"].to_numpy().astype(float), rows["part"].to_numpy() == 0
    lists = rows["terms"].combine_chunks()
    term = lists.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)) if len(y) else np.zeros(0, np.int64)
    del rows, lists
    if not len(y) or y.min() == y.max():
        return fit_terms(doc, term, y, part, None)
    frequent = np.bincount(term[~part[doc]], minlength=1 << BITS) >= LEAST_ROWS

    def pairs(wanted: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Counts of all near pairs that are candidates, or of those that are wanted."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, seen = [], np.zeros(2)
            if wanted is None:
                # a first pass counts hashes of pairs, so that only what may be a candidate is kept by name
                batches, cells = list(batches), [np.zeros(1 << _CELL_BITS, np.uint16) for _ in range(2)]
                for batch in batches:
                    label = batch.column(2).to_numpy()
                    seen += (label.sum(), (1 - label).sum())
                    for d, k in _near_pairs(batch.column(3), BITS, frequent):
                        for c in (0, 1):
                            np.add.at(cells[c], mix(k[label[d] == c]) >> U64(64 - _CELL_BITS), 1)
                live = (cells[1] >= LEAST_ROWS) | (cells[0] >= max(LEAST_ROWS, 0.05 * seen[1]))
                del cells
            for batch in batches:
                label = batch.column(2).to_numpy().astype(float)
                for d, k in _near_pairs(batch.column(3), BITS, frequent):
                    keep = live[mix(k) >> U64(64 - _CELL_BITS)] if wanted is None else np.isin(k, wanted)
                    parts.append(_counted(d[keep], k[keep], label))
            keys, n, p = _summed(parts)
            if wanted is None:
                chosen = np.isin(keys, _candidates(keys, n, p, *seen))
                keys, n, p = keys[chosen], n[chosen], p[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(p.astype(np.int64))], ["pair", "n", "p"])

        return run

    learn, schema = sample.where("part > 0"), "pair long, n long, p long"
    each = int(min(PAIR_ROWS // 2, max(1, y[~part].sum())))
    # candidates come from a bounded number of rows in one task
    some = learn.where("label = 1").orderBy("turn").limit(each).unionByName(learn.where("label = 0").orderBy("turn").limit(each))
    wanted = some.coalesce(1).mapInArrow(pairs(None), schema).select("pair").toArrow()["pair"].to_numpy().view(U64)
    counts = learn.mapInArrow(pairs(np.sort(wanted)), schema).groupBy("pair").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).orderBy("pair").toArrow()
    return fit_terms(doc, term, y, part, (counts["pair"].to_numpy().view(U64), counts["n"].to_numpy(), counts["p"].to_numpy()))


def _scored(model: FactorizationMachine, batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their scores) of a batch, a block of whole texts at a time; no copy of the batch is made."""
    texts = batch.column(text).cast(pa.large_string())
    for a, b in blocks(texts, _BLOCK):
        doc, term = hashed_terms(texts.slice(a, b - a), BITS)
        yield batch.slice(a, b - a), _sigmoid(model.logits(doc, term, b - a))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Only the text is an input of the score.  Null or empty text: the score of no
    terms.  Null ids count as held out.  Repeated rows get equal scores.  Other
    columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [z for _, z in _scored(sent.value, batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    out = own.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null or empty texts have the score of no terms; rows with null or repeated ids
    are judged each by its text; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, scores in _scored(sent.value, batch, at):
                yield rows.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
