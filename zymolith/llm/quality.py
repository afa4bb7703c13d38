"""Document quality by hierarchical empirical Bayes.

A small classifier over the shape of the text gives each document's evidence.
Sums of that evidence by host and by path of a host are shrunk: a path's rate
towards its host's, a host's towards the global one, with prior weights that
are estimated from the spread between groups (method of moments).  A document's
score adds to its own evidence what its path and host say beyond the global
rate, its own share left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear_terms import held_out, labelled_sample
from .shared import empty_text, small_side, written
from .text import U64, blocks, string_bytes, words_of

#: At most so many labelled rows are learnt from.
SAMPLE_ROWS = 8_000
#: A score from here on predicts quality.
THRESHOLD = 0.5
BINS = 12
BROADCAST_ROWS = 1 << 18
_BLOCK = 1 << 20


def shapes(texts: pa.Array) -> np.ndarray:
    """A row of shape features for each whole text."""
    data, doc = string_bytes(texts)
    w = words_of(texts)
    chars = np.maximum(np.diff(doc), 1)
    n = np.maximum(np.diff(w.first), 1)

    def share(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return (total[doc[1:]] - total[doc[:-1]]) / chars

    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122) | (data >= 128)
    stop = np.isin(data, np.frombuffer(b".,;:", np.uint8))
    space = data <= 32
    symbol = ~(upper | digit | lower | stop | space)
    owner = w.owner()
    # a block has fewer than 2**20 texts; 44 bits tell the words of one text apart
    pairs = np.unique((owner.astype(U64) << U64(44)) | (w.hash >> U64(20)))
    distinct = np.bincount((pairs >> U64(44)).astype(np.int64), minlength=len(chars)) / n
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    size = (w.end - w.start).astype(float)
    mean = np.bincount(owner, size, len(chars)) / n
    longest = np.zeros(len(chars))
    np.maximum.at(longest, owner, size)
    return np.stack(
        [share(symbol), share(upper), share(digit), share(stop), share(data == 10), share(data == 124), distinct, np.bincount(owner, again, len(chars)) / n, mean, np.log1p(longest), np.log1p(np.diff(w.first)), np.log(n) * (1 - distinct)],
        1,
    )


def _in_blocks(texts: pa.Array) -> np.ndarray:
    parts = [shapes(texts.slice(a, b - a)) for a, b in blocks(texts, _BLOCK)]
    return np.concatenate(parts) if parts else np.zeros((0, 12))


@dataclass
class ShapeModel:
    """Logistic regression over the quantile bins of each shape feature."""

    cuts: list[np.ndarray]
    weights: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        cols = [np.eye(len(c) + 1)[np.searchsorted(c, x[:, k])] for k, c in enumerate(self.cuts)]
        return np.concatenate([np.ones((len(x), 1)), *cols], 1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -12, 12)))


def fit(texts: list[str], labels: list[int]) -> ShapeModel:
    return fit_shapes(_in_blocks(pa.array(texts, pa.large_string())), np.asarray(labels, float))


def fit_shapes(x: np.ndarray, y: np.ndarray) -> ShapeModel:
    """Newton steps with a ridge; without both classes the chance is the smoothed base rate."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(12)]
    model = ShapeModel(cuts, np.zeros(1 + sum(len(c) + 1 for c in cuts)))
    if not len(y) or y.min() == y.max():
        base = (y.sum() + 4) / (len(y) + 8)
        model.weights[0] = np.log(base / (1 - base))
        return model
    z = model.inputs(x)
    ridge = np.full(z.shape[1], 1.0)
    ridge[0] = 1e-3
    for _ in range(25):
        p = model.chance(x)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break
    return model


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ShapeModel:
    """The classifier, fitted on at most ``sample_rows`` labelled rows; only their shapes, twelve numbers each, come to the driver.

    Null texts are empty ones; without labels every chance is one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _in_blocks(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 12).cast(pa.list_(pa.float64()))], ["turn", "label", "shape"])

    sample = labelled_sample(docs, labels, "quality", sample_rows).select("turn", "label", "text")
    rows = sample.mapInArrow(run, "turn long, label int, shape array<double>").toArrow().sort_by("turn")
    x = np.array(rows["shape"].to_pylist(), float).reshape(-1, 12)
    return fit_shapes(x, rows["label"].to_numpy().astype(float))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _prior_weight(groups: DataFrame, rate: str, total: str, around: Column) -> Column:
    """Weight of the prior in documents, from the spread of the groups' rates around theirs: an aggregate over ``groups``."""
    n, gap = F.sum(total), F.sum(F.col(total) * F.pow(F.col(rate) - around, 2))
    inner = F.sum(F.col(total) * around * (1 - around)) / F.greatest(n, F.lit(1))
    spread = F.greatest(gap / F.greatest(n, F.lit(1)) - inner * F.count(F.lit(1)) / F.greatest(n, F.lit(1)), F.lit(1e-6))
    return F.least(F.greatest(inner / spread - 1, F.lit(1.0)), F.lit(1e4))


def score_quality(docs: DataFrame, model: ShapeModel, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, host, path, evidence, host_rate, path_rate, score, kept), one row per row of ``docs``.

    ``evidence``: the classifier's chance; rates: the shrunk posteriors of its
    groups without the row itself.  Null or empty text: the shape of no text.
    Null host or path: a group of its own.  Null ids count as held out.  Repeated
    rows count each and get equal scores.  Other columns are ignored; an empty
    table gives an empty result.  Groups are summed before they are shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _in_blocks(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sent.value.chance(x))], ["doc_id", "host", "path", "evidence"])

    none = F.lit("\x00null")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), none).alias("host"), F.coalesce(path.cast("string"), none).alias("path"), empty_text(text_col).alias("text"))
    rows = written(own.mapInArrow(run, "doc_id long, host string, path string, evidence double"), "quality")
    paths = rows.groupBy("host", "path").agg(F.sum("evidence").alias("ps"), F.count(F.lit(1)).alias("pn"))
    hosts = paths.groupBy("host").agg(F.sum("ps").alias("hs"), F.sum("pn").alias("hn"))
    groups = written(paths.join(hosts, "host"), "quality-groups")
    overall = hosts.agg(F.coalesce(F.sum("hs") / F.greatest(F.sum("hn"), F.lit(1)), F.lit(0.5)).alias("rate")).first()["rate"]
    by_host = groups.select("host", "hs", "hn").distinct().withColumn("r", F.col("hs") / F.col("hn"))
    host_weight = by_host.agg(F.coalesce(_prior_weight(by_host, "r", "hn", F.lit(overall)), F.lit(1.0)).alias("k")).first()["k"]
    by_path = groups.withColumn("r", F.col("ps") / F.col("pn")).withColumn("around", F.col("hs") / F.col("hn"))
    path_weight = by_path.agg(F.coalesce(_prior_weight(by_path, "r", "pn", F.col("around")), F.lit(1.0)).alias("k")).first()["k"]
    out = rows.join(small_side(groups, BROADCAST_ROWS), ["host", "path"])
    e = F.col("evidence")
    host_rate = (F.col("hs") - e + host_weight * overall) / (F.col("hn") - 1 + host_weight)
    out = out.withColumn("host_rate", host_rate)
    path_rate = (F.col("ps") - e + path_weight * F.col("host_rate")) / (F.col("pn") - 1 + path_weight)
    out = out.withColumn("path_rate", path_rate)
    score = 1 / (1 + F.exp(-(_logit(e) + _logit(F.col("path_rate")) - _logit(F.lit(float(overall))))))
    out = out.withColumn("score", score)
    shown = lambda c: F.when(F.col(c) != none, F.col(c)).alias(c)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), shown("host"), shown("path"), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= THRESHOLD).alias("kept"))
