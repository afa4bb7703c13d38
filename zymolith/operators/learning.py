"""Features, one-vs-rest models, ensembles and parameter search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import ordinals
from ..functions.scratch import written
from .relations import left_impute_zero


def train_features(similarities: DataFrame, owners: DataFrame, train_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, position, value): similarities to the domains of training ids only, with dense positions.

    ``similarities``: long (id, feature, value); ``owners``: (feature, domain, owner).
    Columns of other owners would leak test rows into the features.
    """
    mine = owners.join(train_ids.select(F.col(id_col).alias("owner")).distinct(), "owner", "left_semi").select("feature").distinct()
    places = ordinals(mine, ["feature"], "position").withColumn("position", F.col("position").cast("int"))
    return similarities.join(places, "feature").select(id_col, "position", "value")


def feature_arrays(long: DataFrame, size: int, id_col: str = "id", name: str = "domains") -> DataFrame:
    """(id, array of ``size``): absent positions are 0."""
    filled = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("_m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(F.try_element_at("_m", p), F.lit(0.0)))
    return filled.select(id_col, cells.alias(name))


def joined_features(vectors: DataFrame, domains: DataFrame | None, size: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """(id, features): the vector, followed by the domain array (zeros for ids without one)."""
    own = F.col(column).cast("array<double>")
    if domains is None:
        return vectors.select(id_col, array_to_vector(own).alias("features"))
    both = left_impute_zero(vectors.select(id_col, own.alias(column)), domains, id_col, "domains", size)
    return both.select(id_col, array_to_vector(F.concat(column, "domains")).alias("features"))


def _write_text(path: str, text: str) -> None:
    SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


# Learners by name: each takes parameters and returns an estimator with a probability column.
LEARNERS: dict[str, Callable[..., object]] = {
    "random_forest": lambda **p: RandomForestClassifier(labelCol="label", weightCol="weight", **p),
    "boosted_trees": lambda **p: GBTClassifier(labelCol="label", weightCol="weight", **p),
    "logistic_regression": lambda **p: LogisticRegression(labelCol="label", weightCol="weight", **p),
    "perceptron": lambda **p: MultilayerPerceptronClassifier(labelCol="label", **p),
}


@dataclass
class OneVsRest:
    """One binary model a class over label sets."""

    learner: str
    params: Mapping[str, object] = field(default_factory=dict)
    class_params: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    balanced: bool = False
    models: dict[str, Model] = field(default_factory=dict)

    def fit(self, rows: DataFrame, classes: Sequence[str]) -> OneVsRest:
        """``rows``: (id, features, labels).  Classes with one outcome only are skipped: their score stays 0."""
        rows = rows.cache()
        for c in classes:
            flagged = rows.withColumn("label", F.array_contains("labels", c).cast("double"))
            n, pos = flagged.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
            if not 0 < pos < n:
                continue
            weight = F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if self.balanced else F.lit(1.0)
            model = LEARNERS[self.learner](**{**self.params, **self.class_params.get(c, {})})
            self.models[c] = model.fit(flagged.withColumn("weight", weight))
        rows.unpersist()
        return self

    def predict(self, rows: DataFrame, classes: Sequence[str]) -> DataFrame:
        """(id, class, score), long; classes without a model score 0."""
        out = rows.select("id", "features")
        for k, (_, model) in enumerate(sorted(self.models.items())):
            out = model.transform(out).select("id", "features", *[f"_p{j}" for j in range(k)], vector_to_array("probability")[1].alias(f"_p{k}"))
        place = {c: k for k, c in enumerate(sorted(self.models))}
        scores = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(f"_p{place[c]}") if c in place else F.lit(0.0)).alias("score")) for c in classes])
        return out.select("id", F.explode(scores).alias("x")).select("id", "x.class", "x.score")


    def save(self, path: str) -> None:
        """One directory a class, and the settings."""
        import json

        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/models/{name.encode().hex()}")
        settings = {"learner": self.learner, "params": dict(self.params), "class_params": {k: dict(v) for k, v in self.class_params.items()}, "balanced": self.balanced, "models": {c: type(m).__module__ + ":" + type(m).__name__ for c, m in self.models.items()}}
        _write_text(f"{path}/settings", json.dumps(settings))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OneVsRest:
        import importlib
        import json

        saved = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/settings").collect()))
        kinds = saved.pop("models")
        out = cls(**saved)
        for name, kind in kinds.items():
            module, _, attribute = kind.partition(":")
            if not module.startswith("pyspark.ml."):
                raise ValueError(f"not a Spark model: {kind}")
            out.models[name] = getattr(importlib.import_module(module), attribute).load(f"{path}/models/{name.encode().hex()}")
        return out


def gathered_folds(spark: SparkSession, paths: Sequence[str]) -> list[OneVsRest]:
    """The saved models of several folds, for one ensemble."""
    return [OneVsRest.load(spark, p) for p in paths]


def ensemble_mean(predictions: DataFrame, models: int, skip: str = "Unknown") -> DataFrame:
    """(id, class, score): sum of the models' scores over ``models``; ``-`` in class names becomes ``_``."""
    rows = predictions.where(F.col("class") != skip)
    return rows.groupBy("id", F.translate("class", "-", "_").alias("class")).agg((F.sum("score") / F.lit(models)).alias("score"))


def importances(model: Model) -> list[tuple[int, float]]:
    """(position, importance) of a tree model, largest first."""
    v = model.featureImportances
    return sorted(((int(i), float(x)) for i, x in enumerate(v.toArray())), key=lambda p: (-p[1], p[0]))


def split_importances(rows: DataFrame, vector_size: int, positions: DataFrame, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vector part, domain part) of (position, importance); domains in ``forced`` are added with importance 0."""
    vector = rows.where(F.col("position") < vector_size)
    domain = rows.where(F.col("position") >= vector_size).select((F.col("position") - vector_size).alias("position"), "importance").join(positions, "position")
    domain = domain.groupBy("domain").agg(F.sum("importance").alias("importance"))
    if forced is not None:
        extra = forced.select("domain").distinct().join(domain, "domain", "left_anti").withColumn("importance", F.lit(0.0))
        domain = domain.unionByName(extra)
    return vector, domain


def pca(rows: DataFrame, k: int = 2, id_col: str = "id", column: str = "features") -> tuple[DataFrame, list[float]]:
    """((id, pc array), explained shares) of centred vectors."""
    arrays = rows.select(id_col, vector_to_array(column).alias("_a"))
    means = arrays.select(F.posexplode("_a").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("_mean"))
    centred = arrays.crossJoin(F.broadcast(means)).select(id_col, array_to_vector(F.zip_with("_a", "_mean", lambda a, m: a - m)).alias("centred"))
    model = PCA(k=k, inputCol="centred", outputCol="_pc").fit(centred)
    return model.transform(centred).select(id_col, vector_to_array("_pc").alias("pc")), [float(x) for x in model.explainedVariance]


def random_search(space: Mapping[str, Sequence], trials: int, loss: Callable[[dict], float], start: dict | None = None, seed: int = 42) -> tuple[dict, float]:
    """The parameters with the least loss: the given start first, then random draws from the space."""
    import random

    rnd = random.Random(seed)
    best: tuple[float, dict] | None = None
    for t in range(trials):
        params = dict(start) if t == 0 and start else {k: rnd.choice(list(v)) for k, v in space.items()}
        value = loss(params)
        if best is None or value < best[0]:
            best = (value, params)
    if best is None:
        raise ValueError("no trials")
    return best[1], best[0]


def bayesian_search(space: Mapping[str, Sequence], trials: int, loss: Callable[[dict], float], start: dict | None = None, seed: int = 42) -> tuple[dict, float]:
    """The parameters with the least loss: the given start first, then what promises the most improvement.

    A Gaussian process over the space (places in the lists of values, scaled to [0, 1];
    values that are no numbers count by equality) predicts the loss of every
    combination not tried; the next trial is the one with the greatest expected
    improvement.  Two random trials come before.  The space is a small grid by nature.
    """
    import itertools
    import math
    import random

    import numpy as np

    rnd, names = random.Random(seed), sorted(space)
    grid = [dict(zip(names, v, strict=True)) for v in itertools.product(*[list(space[k]) for k in names])]

    def place(p: Mapping) -> list[float]:
        out = []
        for k in names:
            values = list(space[k])
            if all(isinstance(v, int | float) and not isinstance(v, bool) for v in values):
                out.append(sum(v < p[k] for v in values) / max(len(values) - 1, 1))
            else:
                out += [float(v == p[k]) for v in values]
        return out

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / (2 * 0.3**2))

    tried: list[tuple[float, dict]] = []
    for t in range(trials):
        left = [g for g in grid if all(g != {k: p[k] for k in names if k in p} for _, p in tried)]
        if t == 0 and start:
            params = dict(start)
        elif not left:
            break
        elif len(tried) < 3 or any(k not in tried[0][1] for k in names):
            params = rnd.choice(left)
        else:
            x, y = np.array([place(p) for _, p in tried]), np.array([v for v, _ in tried])
            scale = y.std() or 1.0
            inverse = np.linalg.inv(kernel(x, x) + 1e-4 * np.eye(len(x)))
            cross = kernel(np.array([place(g) for g in left]), x)
            mean = y.mean() + cross @ inverse @ (y - y.mean())
            sd = scale * np.sqrt(np.maximum(1 - (cross @ inverse * cross).sum(1), 1e-12))
            z = (y.min() - mean) / sd
            gain = sd * (z * np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]) + np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
            params = left[int(np.argmax(gain))]
        tried.append((loss(params), params))
    if not tried:
        raise ValueError("no trials")
    value, best = min(tried, key=lambda x: x[0])
    return best, value


@dataclass(frozen=True)
class Dimension:
    """A parameter to search: a range of numbers, whole or not, evenly or by their logarithm, or a list of values."""

    low: float = 0.0
    high: float = 1.0
    whole: bool = False
    logarithmic: bool = False
    values: tuple = ()

    def width(self) -> int:
        return len(self.values) or 1

    def at(self, x: Sequence[float]) -> object:
        """The value at a place of the unit cube."""
        if self.values:
            return self.values[max(range(len(self.values)), key=lambda k: (x[k], -k))]
        import math

        u = min(max(x[0], 0.0), 1.0)
        v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.logarithmic else self.low + u * (self.high - self.low)
        return int(min(max(round(v), self.low), self.high)) if self.whole else v

    def place(self, value: object) -> list[float]:
        if self.values:
            return [float(v == value) for v in self.values]
        import math

        return [(math.log(value / self.low) / math.log(self.high / self.low)) if self.logarithmic else (value - self.low) / ((self.high - self.low) or 1)]


def hedged_search(space: Mapping[str, Dimension], trials: int, losses: Callable[[list[dict]], list[float]], start: dict | None = None, seed: int = 42, first: int = 5, batch: int = 1) -> tuple[dict, float]:
    """The parameters with the least loss over ranges: a Gaussian process and a hedge over three ways to choose the next trial.

    Expected improvement, chance of improvement and the lower confidence bound each
    propose a point; which one is tried is drawn by how low the losses were that
    the process expects at the points each has proposed.  The width of the process's kernel is the
    one with the greatest likelihood.  ``losses`` gets ``batch`` parameter sets at a time,
    so that their fits may be one job; the given start comes first, then ``first`` random points.
    """
    import math

    import numpy as np

    rng, names = np.random.default_rng(seed), sorted(space)
    size = sum(space[n].width() for n in names)

    def params(x: np.ndarray) -> dict:
        out, at = {}, 0
        for n in names:
            out[n] = space[n].at(x[at : at + space[n].width()].tolist())
            at += space[n].width()
        return out

    place = lambda p: np.array([c for n in names for c in space[n].place(p[n])])
    gains, tried, seen = np.zeros(3), [], []

    def ask(found: list[dict]) -> None:
        for p, v in zip(found, losses(found), strict=True):
            tried.append((float(v), p))
            seen.append(place(p))

    opening = ([dict(start)] if start else []) + [params(rng.random(size)) for _ in range(first)]
    opening = opening[:trials]
    for at in range(0, len(opening), batch):
        ask(opening[at : at + batch])
    while len(tried) < trials:
        x, y = np.array(seen), np.array([v for v, _ in tried])
        middle, scale = y.mean(), y.std() or 1.0
        z = (y - middle) / scale
        square = ((x[:, None] - x[None]) ** 2).sum(2)

        def process(width: float, square=square, z=z) -> tuple[float, np.ndarray, np.ndarray]:
            low = np.linalg.cholesky(np.exp(-square / (2 * width**2)) + 1e-5 * np.eye(len(z)))
            half = np.linalg.solve(low, z)
            return float(-0.5 * half @ half - np.log(np.diag(low)).sum()), low, np.linalg.solve(low.T, half)

        width = max((0.1, 0.2, 0.4, 0.8, 1.6), key=lambda w: process(w)[0])
        _, low, weights = process(width)

        def predicted(q: np.ndarray, x=x, width=width, low=low, weights=weights) -> tuple[np.ndarray, np.ndarray]:
            cross = np.exp(-((q[:, None] - x[None]) ** 2).sum(2) / (2 * width**2))
            return cross @ weights, np.sqrt(np.maximum(1 - (np.linalg.solve(low, cross.T) ** 2).sum(0), 1e-10))

        best = x[int(np.argmin(y))]
        cloud = np.concatenate([rng.random((2000, size)), np.clip(best + rng.normal(0, 0.1, (500, size)), 0, 1), np.clip(best + rng.normal(0, 0.02, (500, size)), 0, 1)])
        cloud = np.array([place(params(c)) for c in cloud])  # where whole numbers and listed values are
        mean, sd = predicted(cloud)
        u = (z.min() - 0.01 - mean) / sd
        tail = 0.5 * (1 + np.vectorize(math.erf)(u / math.sqrt(2)))
        ways = [sd * (u * tail + np.exp(-u * u / 2) / math.sqrt(2 * math.pi)), tail, -(mean - 1.96 * sd)]
        new: list[dict] = []
        for _ in range(min(batch, trials - len(tried))):
            points = [int(np.argmax(w)) for w in ways]
            chance = np.exp(gains - gains.max())
            pick = points[int(rng.choice(3, p=chance / chance.sum()))]
            gains -= mean[points]
            new.append(params(cloud[pick]))
            near = ((cloud - cloud[pick]) ** 2).sum(1) < 1e-4  # a batch has other points
            ways = [np.where(near, -np.inf, w) for w in ways]
        ask(new)
    if not tried:
        raise ValueError("no trials")
    value, found = min(tried, key=lambda t: t[0])
    return found, value


def grouped_fold_losses(rows: DataFrame, fit_and_score: Callable[[dict, pd.DataFrame, pd.DataFrame], float], most_rows: int = 1 << 20) -> Callable[[list[dict]], list[float]]:
    """Mean loss over folds of several parameter sets as one job: a task fits one set on one fold.

    ``rows`` have a column ``fold``; each pair of set and fold gets all rows, so they must be at
    most ``most_rows``, which is checked.  ``fit_and_score`` takes (parameters, training rows, test rows).
    """
    import json

    if rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows for a fit in one task")
    names = [c for c in rows.columns if c != "fold"]
    kept = written(rows, "search-rows")
    folds = sorted(r.fold for r in kept.select("fold").distinct().collect())  # a handful

    def losses(sets: list[dict]) -> list[float]:
        work = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(json.dumps(p)).alias("p"), F.lit(f).alias("test")) for k, p in enumerate(sets) for f in folds])
        each = kept.withColumn("w", F.explode(work)).select("w.k", "w.p", "w.test", "fold", *names)

        def call(pdf: pd.DataFrame) -> pd.DataFrame:
            test = pdf["fold"] == pdf["test"].iloc[0]
            loss = fit_and_score(json.loads(pdf["p"].iloc[0]), pdf.loc[~test, names], pdf.loc[test, names])
            return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "loss": [float(loss)]})

        got = {r.k: r.loss for r in each.groupBy("k", "p", "test").applyInPandas(call, "k int, loss double").groupBy("k").agg(F.avg("loss").alias("loss")).collect()}
        return [got[k] for k in range(len(sets))]

    return losses


def keep_params(path: str, params: Mapping[str, object], loss: float) -> bool:
    """Writes (params, loss) as one JSON line unless the file there has a loss as good; whether it wrote."""
    import json

    spark = SparkSession.active()
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files) and json.loads(kept_params(path)[1])["loss"] <= loss:
        return False
    _write_text(path, json.dumps({"params": dict(params), "loss": loss}))
    return True


def kept_params(path: str) -> tuple[dict, str]:
    """(parameters, the whole line) of a file of ``keep_params``."""
    import json

    line = "".join(r["value"] for r in SparkSession.active().read.text(path).collect())
    return json.loads(line)["params"], line


def latest_params(registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, params) of the newest run."""
    return registry.groupBy(*keys).agg(F.max_by("params", "ts").alias("params"))
