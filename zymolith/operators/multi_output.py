"""Learners with many outputs: forests, boosted trees and networks whose gradients Spark adds up.

Rows carry a vector of labels, not a label set as one class, so any number of
combinations may occur.  Trees grow level by level: each task adds its rows into
histograms by tree, node, feature and bin, Spark sums the histograms and finds
the best split of each node on the executors, and only splits come to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.array_sums import array_sums, cells_of
from ..functions.scratch import written

#: Cells of a histogram row: features of a node are split into parts of about a megabyte.
PART_CELLS = 1 << 17
#: Boosting rounds after which margins are written, and accuracy of the quantile sketch.
WRITE_ROUNDS, ACCURACY = 10, 10_000
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bootstrap_weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson of mean 1, from a hash of row and tree."""
    u = (_mixed(_mixed(rows.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2**63)) + _GOLD) >> np.uint64(11)) / float(1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1, 12))]))
    return np.searchsorted(steps, u, side="right").astype(float)


def quantile_cuts(rows: DataFrame, bins: int, column: str = "features") -> list[np.ndarray]:
    """Ascending cut points of each feature from a quantile sketch: at most ``bins`` - 1, without repeats."""
    shares = [k / bins for k in range(1, bins)]
    cells = rows.select(F.posexplode(column).alias("p", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    found = {r["p"]: np.unique(r["q"]) for r in cells.groupBy("p").agg(F.percentile_approx("x", shares, ACCURACY).alias("q")).collect()}  # one row a feature
    size = rows.agg(F.max(F.size(column))).first()[0] or 0
    return [found.get(p, np.zeros(0)) for p in range(size)]


@dataclass
class Tree:
    """Nodes as arrays: a row with a bin above ``cut`` of ``feature`` goes right; leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[]])

    def split(self, node: int, feature: int, cut: int, left: Sequence[float], right: Sequence[float]) -> None:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in (left, right):
            self.feature.append(-1), self.cut.append(0), self.left.append(-1), self.right.append(-1), self.value.append(list(v))

    def places(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at, live = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while len(live):
            live = live[feature[at[live]] >= 0]
            node = at[live]
            at[live] = np.where(binned[live, feature[node]] > cut[node], right[node], left[node])
        return at

    def scores(self, binned: np.ndarray) -> np.ndarray:
        return np.array(self.value, float)[self.places(binned)]


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each cell: how many cut points lie below it; missing ones are in bin 0."""
    return np.stack([np.where(np.isnan(x[:, p]), 0, np.searchsorted(c, x[:, p], "left")) for p, c in enumerate(cuts)], 1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def prepared(rows: DataFrame, classes: Sequence[str], cuts: Sequence[np.ndarray], weight: str | None = None) -> DataFrame:
    """A written table (row, bins binary, y array<double>, w) of ``rows`` (id, features array, labels); ``row`` is a hash of the id."""
    y = F.array(*[F.coalesce(F.array_contains("labels", c), F.lit(False)).cast("double") for c in classes])
    known = rows.select(F.xxhash64("id").alias("row"), F.col("features"), y.alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    cuts = list(cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            binned = to_bins(_matrix(b.column(1), len(cuts)), cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in binned], pa.binary()), b.column(2), b.column(3)], ["row", "bins", "y", "w"])

    return written(known.mapInArrow(work, "row long, bins binary, y array<double>, w double"), "trees-rows")


def _batch(b: pa.RecordBatch, features: int, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    binned = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, features)
    return b.column(0).to_numpy(), binned, _matrix(b.column(2), outputs), b.column(3).to_numpy()


def node_features(seed: int, tree: int, node: int, features: int, share: int) -> np.ndarray:
    """The features that a node may split by, ``share`` of them, the same in every task."""
    if share >= features:
        return np.arange(features)
    return np.sort(np.random.default_rng([seed, tree, node]).choice(features, share, replace=False))


def histograms(binned: np.ndarray, cells: np.ndarray, features: np.ndarray, bins: int) -> np.ndarray:
    """(features, bins, channels): sums of ``cells`` (rows x channels) by bin of each feature."""
    out = np.zeros((len(features), bins, cells.shape[1]))
    for k, f in enumerate(features):
        for c in range(cells.shape[1]):
            out[k, :, c] = np.bincount(binned[:, f], cells[:, c], bins)
    return out


def gini_gain(left: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Decrease of the Gini impurity summed over outputs; channels are the weight and the weighted labels."""

    def purity(s: np.ndarray) -> np.ndarray:
        w = np.maximum(s[..., :1], 1e-300)
        p = s[..., 1:] / w
        return (s[..., :1] * (p * p + (1 - p) ** 2)).sum(-1)

    right = total - left
    return np.where((left[..., 0] >= least) & (right[..., 0] >= least), purity(left) + purity(right) - purity(total), -np.inf)


def newton_gain(left: np.ndarray, total: np.ndarray, least: float, penalty: float, cost: float) -> np.ndarray:
    """Second-order gain with a quadratic penalty of leaf values and a cost of each split; channels are gradient and curvature."""

    def part(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + penalty)

    right = total - left
    return np.where((left[..., 1] >= least) & (right[..., 1] >= least), 0.5 * (part(left) + part(right) - part(total)) - cost, -np.inf)


def best_splits(sums: DataFrame, bins: int, channels: int, seed: int, features: int, take: int, part: int, gain) -> dict[tuple[int, int], tuple]:
    """{(tree, node): (gain, feature, cut, sums to the left, all sums)}; ties: the lower feature, then the lower cut."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                tree, node, piece = (b.column(c)[k].as_py() for c in range(3))
                own = node_features(seed, tree, node, features, take)[piece * part : (piece + 1) * part]
                h = cells_of(b.column(3)[k].as_py(), (len(own), bins, channels))
                left, total = np.cumsum(h, 1)[:, :-1], h.sum(1)
                g = gain(left, total[:, None])
                f, c = np.unravel_index(int(np.argmax(g)), g.shape)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (tree, node)] + [pa.array([float(g[f, c])]), pa.array([int(own[f])]), pa.array([int(c)]), pa.array([left[f, c].tolist()]), pa.array([total[f].tolist()])], ["tree", "node", "gain", "feature", "cut", "low", "all"])

    found = sums.mapInArrow(call, "tree long, node long, gain double, feature long, cut long, low array<double>, all array<double>")
    best = found.groupBy("tree", "node").agg(F.max_by(F.struct("gain", "feature", "cut", "low", "all"), F.struct("gain", -F.col("feature"), -F.col("cut"))).alias("s"))
    return {(r.tree, r.node): tuple(r.s) for r in best.collect()}  # one row a node


@dataclass
class SharedForest:
    """Trees whose leaves score all labels: multi-output as in one model, on bootstrap rows and some features a node."""

    trees: int = 100
    depth: int = 8
    bins: int = 32
    features_per_node: int | None = None
    least_rows: float = 1.0
    seed: int = 0
    classes: list[str] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    grown: list[Tree] = field(default_factory=list)

    def fit(self, rows: DataFrame, classes: Sequence[str], weight: str | None = None) -> SharedForest:
        """``rows``: (id, features, labels); labels outside ``classes`` are ignored.  Without rows all scores are 0."""
        rows = _arrays(rows)
        self.classes, self.cuts = list(classes), quantile_cuts(rows, self.bins)
        features, outputs = len(self.cuts), len(self.classes)
        take = self.features_per_node or max(1, int(np.sqrt(features)))
        table = prepared(rows, self.classes, self.cuts, weight)
        self.grown = [Tree() for _ in range(self.trees)]
        live = {(t, 0) for t in range(self.trees)}
        for _ in range(self.depth):
            if not live or not features:
                break
            got = self._level(table, live, features, outputs, take)
            after: set[tuple[int, int]] = set()
            for (t, node), (gain, f, c, low, total) in sorted(got.items()):
                tree, low, total = self.grown[t], np.array(low), np.array(total)
                if not tree.value[node]:
                    tree.value[node] = (total[1:] / max(total[0], 1e-300)).tolist()
                if gain <= 1e-9 * max(total[0], 1):
                    continue
                sides = [low, total - low]
                tree.split(node, f, c, *[(s[1:] / max(s[0], 1e-300)).tolist() for s in sides])
                after |= {(t, n) for n, s in zip((tree.left[node], tree.right[node]), sides, strict=True) if s[0] >= 2 * self.least_rows and ((s[1:] > 1e-9) & (s[1:] < s[0] - 1e-9)).any()}
            live = after
        for tree in self.grown:
            tree.value = [v or [0.0] * outputs for v in tree.value]
        return self

    def _level(self, table: DataFrame, live: set[tuple[int, int]], features: int, outputs: int, take: int) -> dict:
        part = max(1, PART_CELLS // (self.bins * (outputs + 1)))
        grown, bins, seed, wanted = self.grown, self.bins, self.seed, {t: sorted(n for u, n in live if u == t) for t in {u for u, _ in live}}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                row, binned, y, w = _batch(b, features, outputs)
                for t, nodes in wanted.items():
                    at, own = grown[t].places(binned), w * bootstrap_weights(row, t, seed)
                    for n in nodes:
                        mine = np.flatnonzero((at == n) & (own > 0))
                        if len(mine):
                            cells = own[mine, None] * np.concatenate([np.ones((len(mine), 1)), y[mine]], 1)
                            h = histograms(binned[mine], cells, node_features(seed, t, n, features, take), bins)
                            total[t, n] = total[t, n] + h if (t, n) in total else h
            for (t, n), h in sorted(total.items()):
                for p in range(-(-len(h) // part)):
                    yield (t, n, p), h[p * part : (p + 1) * part]

        sums = array_sums(table, work, ["tree", "node", "piece"])
        least = self.least_rows
        return best_splits(sums, bins, outputs + 1, seed, features, take, part, lambda left, total: gini_gain(left, total, least))

    def predict(self, rows: DataFrame, classes: Sequence[str]) -> DataFrame:
        """(id, class, score), long: mean of the trees' leaves; classes that were not learnt score 0."""
        grown, cuts = self.grown, self.cuts

        def score(x: np.ndarray) -> np.ndarray:
            binned = to_bins(x, cuts)
            return sum((t.scores(binned) for t in grown), np.zeros((len(x), len(self.classes)))) / max(len(grown), 1)

        return _long_scores(_arrays(rows), score, len(cuts), self.classes, classes)


@dataclass
class NewtonBoosting:
    """Trees on gradients and curvatures, one an output and round; ``loss`` is logistic (labels apart) or softmax (one of all)."""

    rounds: int = 50
    depth: int = 4
    rate: float = 0.3
    penalty: float = 1.0
    cost: float = 0.0
    least_curvature: float = 1.0
    bins: int = 32
    loss: str = "logistic"
    seed: int = 0
    classes: list[str] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    grown: list[list[Tree]] = field(default_factory=list)

    def slopes(self, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient, curvature) of the loss at each margin."""
        p = self.chance(margin)
        return p - y, np.maximum((2.0 if self.loss == "softmax" else 1.0) * p * (1 - p), 1e-16)

    def chance(self, margin: np.ndarray) -> np.ndarray:
        if self.loss == "softmax":
            e = np.exp(margin - margin.max(1, keepdims=True)) if margin.shape[1] else margin
            return e / e.sum(1, keepdims=True)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def fit(self, rows: DataFrame, classes: Sequence[str], weight: str | None = None, cuts: Sequence[np.ndarray] | None = None) -> NewtonBoosting:
        """``rows``: (id, features, labels).  Margins start at 0 and are written every WRITE_ROUNDS rounds."""
        rows = _arrays(rows)
        self.classes, self.cuts, self.grown = list(classes), quantile_cuts(rows, self.bins) if cuts is None else list(cuts), []
        features, outputs = len(self.cuts), len(self.classes)
        table = prepared(rows, self.classes, self.cuts, weight).withColumn("margin", F.array_repeat(F.lit(0.0), outputs))
        since = 0
        for _ in range(self.rounds if features else 0):
            trees = [Tree() for _ in range(outputs)]
            live = {(k, 0) for k in range(outputs)}
            for _ in range(self.depth):
                if not live:
                    break
                got = self._level(table, self.grown[since:], trees, live, features, outputs)
                after: set[tuple[int, int]] = set()
                for (k, node), (gain, f, c, low, total) in sorted(got.items()):
                    low, total = np.array(low), np.array(total)
                    if not trees[k].value[node]:
                        trees[k].value[node] = [self._leaf(total)]
                    if gain > 1e-12:
                        trees[k].split(node, f, c, [self._leaf(low)], [self._leaf(total - low)])
                        after |= {(k, trees[k].left[node]), (k, trees[k].right[node])}
                live = after
            for t in trees:
                t.value = [v or [0.0] for v in t.value]
            self.grown.append(trees)
            if len(self.grown) - since == WRITE_ROUNDS:
                table, since = self._written(table, self.grown[since:], features, outputs), len(self.grown)
        return self

    def _leaf(self, sums: np.ndarray) -> float:
        return float(-self.rate * sums[0] / (sums[1] + self.penalty))

    def _level(self, table: DataFrame, new: list[list[Tree]], trees: list[Tree], live: set[tuple[int, int]], features: int, outputs: int) -> dict:
        part, bins, model = max(1, PART_CELLS // (self.bins * 2)), self.bins, self
        wanted = {k: sorted(n for u, n in live if u == k) for k in {u for u, _ in live}}
        every = np.arange(features)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                _, binned, y, w = _batch(b, features, outputs)
                g, h = model.slopes(_margins(_matrix(b.column(4), outputs), binned, new), y)
                for k, nodes in wanted.items():
                    at = trees[k].places(binned)
                    for n in nodes:
                        mine = np.flatnonzero(at == n)
                        if len(mine):
                            own = histograms(binned[mine], w[mine, None] * np.stack([g[mine, k], h[mine, k]], 1), every, bins)
                            total[k, n] = total[k, n] + own if (k, n) in total else own
            for (k, n), own in sorted(total.items()):
                for p in range(-(-features // part)):
                    yield (k, n, p), own[p * part : (p + 1) * part]

        least, penalty, cost = self.least_curvature, self.penalty, self.cost
        sums = array_sums(table.select("row", "bins", "y", "w", "margin"), work, ["tree", "node", "piece"])
        return best_splits(sums, bins, 2, self.seed, features, features, part, lambda left, total: newton_gain(left, total, least, penalty, cost))

    def _written(self, table: DataFrame, new: list[list[Tree]], features: int, outputs: int) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, binned, _, _ = _batch(b, features, outputs)
                margin = _margins(_matrix(b.column(4), outputs), binned, new)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list(margin), pa.list_(pa.float64()))], ["row", "bins", "y", "w", "margin"])

        return written(table.select("row", "bins", "y", "w", "margin").mapInArrow(work, "row long, bins binary, y array<double>, w double, margin array<double>"), "boosting-margins")

    def predict(self, rows: DataFrame, classes: Sequence[str]) -> DataFrame:
        """(id, class, score), long; classes that were not learnt score 0."""
        cuts, grown, outputs = self.cuts, self.grown, len(self.classes)

        def score(x: np.ndarray) -> np.ndarray:
            return self.chance(_margins(np.zeros((len(x), outputs)), to_bins(x, cuts), grown))

        return _long_scores(_arrays(rows), score, len(cuts), self.classes, classes)


def _margins(margin: np.ndarray, binned: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = margin.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            out[:, k] += t.scores(binned)[:, 0]
    return out


@dataclass
class SigmoidNetwork:
    """A network with a logistic output for each label, fitted by limited-memory quasi-Newton steps on gradients that Spark adds up.

    One pass over the rows gives the loss and gradient at several step lengths.
    """

    hidden: tuple[int, ...] = (100,)
    alpha: float = 1e-4
    steps: int = 50
    memory: int = 10
    seed: int = 0
    lengths: tuple[float, ...] = (1.0, 0.3, 0.08, 0.01)
    classes: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    middle: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    losses: list[float] = field(default_factory=list)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Activations of all layers, the last before its logistic."""
        out = [(x - self.middle) / self.spread]
        layers = self.layers(flat)
        for k, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(z if k == len(layers) - 1 else np.maximum(z, 0))
        return out

    def loss_and_gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over rows, without the penalty."""
        acts, layers = self.forward(flat, x), self.layers(flat)
        z = acts[-1]
        loss = float((weight[:, None] * (np.logaddexp(0, z) - y * z)).sum())
        d, parts = weight[:, None] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y), []
        for k in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate([(acts[k].T @ d).ravel(), d.sum(0)]))
            if k:
                d = (d @ layers[k][0].T) * (acts[k] > 0)
        return loss, np.concatenate(parts[::-1])

    def fit(self, rows: DataFrame, classes: Sequence[str], weight: str | None = None) -> SigmoidNetwork:
        """``rows``: (id, features, labels); labels outside ``classes`` are ignored."""
        rows = _arrays(rows)
        self.classes, outputs = list(classes), len(classes)
        y = F.array(*[F.coalesce(F.array_contains("labels", c), F.lit(False)).cast("double") for c in classes])
        table = written(rows.select("features", y.alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")), "network-rows")
        stats = table.select(F.posexplode("features").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()  # one row a feature
        width = max((r.p for r in stats), default=-1) + 1
        self.middle, self.spread = np.zeros(width), np.ones(width)
        for r in stats:
            self.middle[r.p], self.spread[r.p] = r.m, r.s if r.s > 1e-12 else 1.0
        self.sizes, rng = [width, *self.hidden, outputs], np.random.default_rng(self.seed)
        self.weights = np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True)])
        total = table.agg(F.sum("w")).first()[0] or 0.0
        self.losses = []
        if not width or not total:
            return self
        (loss, grad), = self._passes(table, [self.weights], total, outputs)
        self.losses, moves = [loss], []
        for _ in range(self.steps):
            way = -self._two_loops(grad, moves)
            slope = float(way @ grad)
            if slope >= 0:
                moves, way = [], -grad
                slope = float(way @ grad)
            first = 1.0 if moves else min(1.0, 1 / np.abs(grad).sum())
            tried = [self.weights + first * t * way for t in self.lengths]
            got = self._passes(table, tried, total, outputs)
            good = [k for k, (v, _) in enumerate(got) if v <= loss + 1e-4 * first * self.lengths[k] * slope]
            if not good:
                if not moves:
                    break
                moves = []
                continue
            k = min(good, key=lambda k: got[k][0])
            s, g = tried[k] - self.weights, got[k][1] - grad
            if float(s @ g) > 1e-12:
                moves = [*moves, (s, g)][-self.memory :]
            done = loss - got[k][0] <= 1e-8 * max(abs(loss), 1)
            self.weights, (loss, grad) = tried[k], got[k]
            self.losses.append(loss)
            if done:
                break
        return self

    def _two_loops(self, grad: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        q, kept = grad.copy(), []
        for s, g in reversed(moves):
            a = float(s @ q) / float(s @ g)
            kept.append(a)
            q -= a * g
        if moves:
            s, g = moves[-1]
            q *= float(s @ g) / float(g @ g)
        for (s, g), a in zip(moves, reversed(kept), strict=True):
            q += s * (a - float(g @ q) / float(s @ g))
        return q

    def _passes(self, table: DataFrame, tried: list[np.ndarray], total: float, outputs: int) -> list[tuple[float, np.ndarray]]:
        model, width = self, self.sizes[0]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
            sums = [np.zeros(len(w) + 1) for w in tried]
            for b in batches:
                x, y, w = _matrix(b.column(0), width), _matrix(b.column(1), outputs), b.column(2).to_numpy()
                for k, flat in enumerate(tried):
                    loss, grad = model.loss_and_gradient(flat, x, y, w)
                    sums[k][0] += loss
                    sums[k][1:] += grad
            for k, cells in enumerate(sums):
                yield (k,), cells

        got = {r.k: cells_of(r.cells, (-1,)) for r in array_sums(table, work, ["k"]).collect()}  # one row a step length
        decay = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True)])
        return [(float(got[k][0] / total + 0.5 * self.alpha * (decay * w * w).sum()), got[k][1:] / total + self.alpha * decay * w) for k, w in enumerate(tried)]

    def predict(self, rows: DataFrame, classes: Sequence[str]) -> DataFrame:
        """(id, class, score), long; classes that were not learnt score 0."""
        return _long_scores(_arrays(rows), lambda x: 1 / (1 + np.exp(-np.clip(self.forward(self.weights, x)[-1], -500, 500))), self.sizes[0], self.classes, classes)


def _arrays(rows: DataFrame) -> DataFrame:
    """``features`` as an array of doubles."""
    kind = dict(rows.dtypes)["features"]
    return rows.withColumn("features", vector_to_array("features") if kind in ("vector", "udt") else F.col("features").cast("array<double>"))


def _long_scores(rows: DataFrame, score, width: int, learnt: Sequence[str], classes: Sequence[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score(_matrix(b.column(1), width)) if b.num_rows and width else np.zeros((b.num_rows, len(learnt)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(p), pa.list_(pa.float64()))], ["id", "p"])

    out = rows.select("id", "features").mapInArrow(work, f"id {dict(rows.dtypes)['id']}, p array<double>")
    place = {c: k for k, c in enumerate(learnt)}
    scores = F.array(*[F.struct(F.lit(c).alias("class"), (F.col("p")[place[c]] if c in place else F.lit(0.0)).alias("score")) for c in classes])
    return out.select("id", F.explode(scores).alias("x")).select("id", "x.class", "x.score")


def keep_trees(path: str, model: SharedForest | NewtonBoosting) -> None:
    """Writes a model of trees as one line of JSON."""
    plain = {**vars(model), "cuts": [c.tolist() for c in model.cuts], "grown": [[vars(t) for t in (x if isinstance(x, list) else [x])] for x in model.grown]}
    SparkSession.active().createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def kept_trees(path: str, kind: type) -> SharedForest | NewtonBoosting:
    plain = json.loads("".join(r["value"] for r in SparkSession.active().read.text(path).collect()))
    grown = [[Tree(**t) for t in x] for x in plain.pop("grown")]
    cuts = [np.array(c) for c in plain.pop("cuts")]
    return kind(**plain, cuts=cuts, grown=grown if kind is NewtonBoosting else [x[0] for x in grown])
