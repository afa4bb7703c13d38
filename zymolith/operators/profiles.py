"""Profiles of aligned sequences and their scores: many sequences at a time against each profile.

A profile has a match, an insert and a delete state for each kept column.
Counts of letters and steps are sums over all aligned rows of a class, added up by
Spark; a class may be any text, as a kind and a kingdom together.  Sequences are
scored against a null model of the letters' shares, the whole profile against any
stretch of the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.array_sums import array_sums, cells_of
from ..functions.scratch import written

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
#: Classes whose counts one task keeps; more are counted in turns.
CLASSES_AT_ONCE = 256
#: Cells that a batch of sequences has in one profile.
BATCH_CELLS = 1 << 18
# steps of a profile: from match, insert and delete of a column to the match and delete of the next and to its own insert
STEPS = ("mm", "mi", "md", "im", "ii", "dm", "dd")


@dataclass(frozen=True)
class Profile:
    """Logarithms: ``match`` (columns x letters) against the null model, ``steps`` (columns x STEPS)."""

    name: str
    match: np.ndarray
    steps: np.ndarray

    def __len__(self) -> int:
        return len(self.match)


def coded(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters as numbers padded to one length, lengths); other letters are one number more than the last."""
    table = np.full(256, len(LETTERS), np.int64)
    table[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    size = np.array([len(s) for s in sequences], np.int64)
    out = np.full((len(sequences), int(size.max(initial=0))), len(LETTERS), np.int64)
    for k, s in enumerate(sequences):
        out[k, : len(s)] = table[np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8)]
    return out, size


def scores(profile: Profile, sequences: list[str], best_path: bool = False) -> np.ndarray:
    """Log odds of each sequence: summed over all paths, or of the best one; an empty sequence has none."""
    out = np.full(len(sequences), -np.inf)
    add = np.maximum if best_path else np.logaddexp
    order = np.argsort([len(s) for s in sequences], kind="stable")
    step = max(1, BATCH_CELLS // max(len(profile), 1))
    for at in range(0, len(order), step):
        mine = order[at : at + step]
        out[mine] = _scores(profile, [sequences[k] for k in mine], add)
    return out


def _scores(profile: Profile, sequences: list[str], add) -> np.ndarray:
    x, size = coded(sequences)
    n, width = len(sequences), len(profile)
    emit = np.concatenate([profile.match, np.zeros((width, 1))], 1).T  # a letter that is none of LETTERS says nothing
    t = dict(zip(STEPS, profile.steps.T, strict=True))
    none = np.full((n, width), -np.inf)
    m, i, d, total = none.copy(), none.copy(), none.copy(), np.full(n, -np.inf)
    # deletes carry on within a row of the sequence: sums of their steps from the first column
    run = np.concatenate([[0.0], np.cumsum(t["dd"][:-1])])
    # the profile may begin with deletes: into column j through j of them
    enter = np.zeros(width)
    enter[1:] = t["md"][0] + run[:-1] - run[0] if width > 1 else 0
    enter[1:] += t["dm"][:-1]
    # and end with them: from column j on
    leave = np.zeros(width)
    leave[:-1] = t["md"][:-1] + run[-1] - run[1:]
    for k in range(x.shape[1]):
        live = k < size
        come = add(add(m + t["mm"], i + t["im"]), d + t["dm"])
        new = np.concatenate([np.full((n, 1), -np.inf), come[:, :-1]], 1)
        new = emit[x[:, k]] + add(new, enter)
        i = add(m + t["mi"], i + t["ii"])
        through = add.accumulate(new + t["md"] - np.concatenate([run[1:], [run[-1]]]), 1)
        d = np.concatenate([np.full((n, 1), -np.inf), through[:, :-1] + run[1:]], 1)
        m = new
        ended = add.reduce(m + leave, 1)
        total = np.where(live, add(total, ended), total)
    return total


def _classes(aligned: DataFrame) -> list[str]:
    return sorted(r["class"] for r in aligned.select("class").distinct().collect())  # one row a profile


def profiles(aligned: DataFrame, least_share: float = 0.5, prior: float = 1.0, step_prior: float = 0.5) -> list[Profile]:
    """A profile a class from (class, aligned), sequences of one class padded to one length by gaps (- or .).

    A column is kept if at least ``least_share`` of the class's rows have a letter
    there; letters elsewhere are inserts.  ``prior`` letters by the shares of all classes and
    ``step_prior`` of each step are added to the counts.  Letters outside LETTERS count as none.
    Classes without a kept column have no profile.
    """
    aligned = written(aligned.where(F.col("aligned").isNotNull() & F.col("class").isNotNull()).groupBy("class", F.upper("aligned").alias("aligned")).agg(F.count(F.lit(1)).alias("n")), "profile-rows")
    widths = {r["class"]: r["w"] for r in aligned.groupBy("class").agg(F.max(F.length("aligned")).alias("w")).collect()}  # one row a profile
    names = sorted(widths)
    out: list[Profile] = []
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for at in range(0, len(names), CLASSES_AT_ONCE):
        some = names[at : at + CLASSES_AT_ONCE]
        rows = aligned.where(F.col("class").isin(*some))
        letters = _sums(rows, some, lambda name, codes, n: _letter_counts(codes, widths[name], n))
        kept = {}
        for name in some:
            cells = letters[name].reshape(widths[name], len(LETTERS) + 2)
            kept[name] = np.flatnonzero(cells[:, :-1].sum(1) >= least_share * cells.sum(1))
            counted[name] = (cells[kept[name]][:, : len(LETTERS)], np.zeros(0))
        steps = _sums(rows, some, lambda name, codes, n: _step_counts(codes, widths[name], kept[name], n))
        for name in some:
            counted[name] = (counted[name][0], steps[name].reshape(-1, len(STEPS)))
    shares = sum((c.sum(0) for c, _ in counted.values()), np.full(len(LETTERS), 1.0))
    shares = shares / shares.sum()
    for name in names:
        letters, steps = counted[name]
        if not len(letters):
            continue
        match = (letters + prior * shares) / (letters.sum(1, keepdims=True) + prior)
        s = steps + step_prior
        s[:, :3] /= s[:, :3].sum(1, keepdims=True)
        s[:, 3:5] /= s[:, 3:5].sum(1, keepdims=True)
        s[:, 5:] /= s[:, 5:].sum(1, keepdims=True)
        out.append(Profile(name, np.log(match / shares), np.log(s)))
    return out


def _sums(rows: DataFrame, names: list[str], count) -> dict[str, np.ndarray]:
    place = {n: k for k, n in enumerate(names)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[tuple[str, int]]] = {}
            for name, text, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                by.setdefault(name, []).append((text, n))
            for name, texts in by.items():
                own = count(name, _aligned_codes([t for t, _ in texts]), np.array([n for _, n in texts], float))
                total[name] = total[name] + own if name in total else own
        for name, cells in sorted(total.items()):
            yield (place[name],), cells

    return {names[r.k]: cells_of(r.cells, (-1,)) for r in array_sums(rows.select("class", "aligned", "n"), work, ["k"]).collect()}  # one row a profile


def _aligned_codes(texts: list[str]) -> np.ndarray:
    """Letters as numbers, other letters as one more, gaps and places behind the end as two more."""
    gap = len(LETTERS) + 1
    x, _ = coded(texts)
    size = np.array([len(t) for t in texts])
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
        x[k, : len(t)][(raw == ord("-")) | (raw == ord("."))] = gap
    x[np.arange(x.shape[1]) >= size[:, None]] = gap
    return x


def _letter_counts(codes: np.ndarray, width: int, n: np.ndarray) -> np.ndarray:
    out = np.zeros((width, len(LETTERS) + 2))
    for c in range(len(LETTERS) + 2):
        out[: codes.shape[1], c] = n @ (codes == c)
    out[codes.shape[1] :, -1] = n.sum()
    return out.ravel()


def _step_counts(codes: np.ndarray, width: int, kept: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each step is taken from each kept column; an insert that follows a delete, or goes before one, counts as one of a match."""
    gap = len(LETTERS) + 1
    codes = np.concatenate([codes, np.full((len(codes), width - codes.shape[1]), gap)], 1)
    out = np.zeros((len(kept), len(STEPS)))
    there = codes != gap
    for k in range(len(kept) - 1):
        a, b = there[:, kept[k]], there[:, kept[k + 1]]
        between = there[:, kept[k] + 1 : kept[k + 1]].sum(1)
        out[k, 0] = n @ (a & b & (between == 0))
        out[k, 1] = n @ (a & (between > 0))
        out[k, 2] = n @ (a & ~b & (between == 0))
        out[k, 3] = n @ (a & (between > 0))
        out[k, 4] = n[a] @ np.maximum(between[a] - 1, 0)
        out[k, 5] = n @ (~a & b)
        out[k, 6] = n @ (~a & ~b)
    return out.ravel()


def profile_scores(sequences: DataFrame, known: list[Profile], best_path: bool = False) -> DataFrame:
    """(id, class, score): log odds of each sequence (id, sequence) under each profile; null and empty sequences have none."""
    rows = sequences.where(F.col("sequence").isNotNull() & (F.col("sequence") != "")).select("id", "sequence")
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)  # a small file has as many rows out as profiles times its own

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded_texts = b.column(1).dictionary_encode()  # a text is scored once a batch
            texts, place = coded_texts.dictionary.to_pylist(), coded_texts.indices.to_numpy()
            for p in known:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.name] * len(place)), pa.array(scores(p, texts, best_path)[place])], ["id", "class", "score"])

    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, class string, score double")
