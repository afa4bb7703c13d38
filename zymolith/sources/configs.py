"""Configurations and results on the driver: small trees of small files."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sides import small_side


def _scalar(text: str):
    text = text.strip()
    if text in ("", "~", "null", "None", "'None'", '"None"'):
        return None
    if text[:1] == text[-1:] and text[:1] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_config(text: str) -> dict:
    """Nested ``key: value`` lines and ``- item`` lists by indentation; "None" is null."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (y.split(" #")[0].rstrip() for y in text.splitlines()) if x.strip() and not x.strip().startswith("#")]

    def block(at: int, indent: int):
        out: dict | list = {}
        while at < len(lines) and lines[at][0] >= indent:
            line = lines[at][1]
            if line.startswith("- "):
                out = out if isinstance(out, list) else []
                out.append(_scalar(line[2:]))
                at += 1
                continue
            key, _, value = line.partition(":")
            at += 1
            if not value.strip() and at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                out[key.strip()], at = block(at, lines[at][0])
            else:
                out[key.strip()] = _scalar(value)
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load_config(path: str | Path) -> dict:
    """A configuration file; ``include`` names one to start from, relative to it, whose values it overrides."""
    path = Path(path)
    own = parse_config(path.read_text())
    base = own.pop("include", None)
    return ({} if base is None else load_config(path.parent / base)) | own


def typed(kind: type, values: dict):
    """An instance of a dataclass; unknown or missing names are errors."""
    names = {f.name for f in fields(kind)}
    if extra := set(values) - names:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return kind(**values)


@dataclass(frozen=True, order=True)
class Experiment:
    """Identity of a run; ordered by its fields."""

    model_type: str
    model_version: str
    fold: str = "all_folds"
    class_name: str = "all_classes"


def discover(root: str | Path) -> list[tuple[str, str]]:
    """(type, version) for each two-level configuration directory without the suffix ``.ignore``."""
    return sorted((t.name, v.name) for t in Path(root).iterdir() if t.is_dir() and t.suffix != ".ignore" for v in t.iterdir() if v.is_dir() and v.suffix != ".ignore")


def latest_results(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fold, class, path): the newest run of each, from the fold or else all folds, from the class or else all classes.

    ``registry``: (fold, class, ts, path); ``wanted``: (fold, class).
    """
    runs = registry.groupBy(F.col("fold").alias("rf"), F.col("class").alias("rc")).agg(F.max_by("path", "ts").alias("path"))
    fits = ((F.col("rf") == F.col("fold")) | (F.col("rf") == "all_folds")) & ((F.col("rc") == F.col("class")) | (F.col("rc") == "all_classes"))
    rank = (F.col("rf") == F.col("fold")).cast("int") * 2 + (F.col("rc") == F.col("class")).cast("int")
    return wanted.join(small_side(runs), fits).groupBy("fold", "class").agg(F.max_by("path", rank).alias("path"))


def discovered_table(spark: SparkSession, root: str | Path) -> DataFrame:
    return spark.createDataFrame(discover(root), "model_type string, model_version string")
