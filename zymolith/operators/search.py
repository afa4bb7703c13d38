"""Nearest sequences by seeds, banded local alignment and expectation values.

Equal sequences are searched once.  Seeds are words whose length follows from how
often they occur: short ones where they are rare, and the longer word at the same
place where the short one is frequent, so common words make no pairs of their own
and nothing that shares a long word is lost.  Two seeds near each other on one
diagonal, or one long seed, make a pair of sequences a candidate; candidates are
aligned in a band about their densest diagonal, many at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written

# Residues of similar chemistry.
GROUPS = ("AGST", "C", "DENQ", "FWY", "HKR", "ILMV", "P")
#: Lengths of short and long words, and references that may share a short one.
SHORT, LONG, FREQUENT = 4, 8, 256
#: Letters between two seeds of a diagonal at most, and diagonals on either side that the band has.
REACH, BAND = 40, 48
#: Cells of the band that a batch of pairs may have at a time.
BATCH_CELLS = 1 << 19
#: Salt values that the copies of one sequence are dealt to before the least ids are taken.
DEALT = 64
_LOW = np.int32(-(1 << 28))


@dataclass(frozen=True)
class Scoring:
    """Scores of letters and gaps; ``table`` overrides pairs of letters, in either order."""

    same: int = 5
    similar: int = 1
    other: int = -3
    gap_open: int = 11
    gap_more: int = 1
    groups: tuple[str, ...] = GROUPS
    table: Mapping[tuple[str, str], int] = field(default_factory=dict)
    #: Constant of the expectation value.
    k: float = 0.041

    def matrix(self) -> np.ndarray:
        """256 x 256 scores of bytes."""
        out = np.full((256, 256), self.other, np.int32)
        for g in self.groups:
            own = [ord(c) for c in g]
            out[np.ix_(own, own)] = self.similar
        np.fill_diagonal(out, self.same)
        for (a, b), s in self.table.items():
            out[ord(a), ord(b)] = out[ord(b), ord(a)] = s
        return out

    def decay(self, shares: Mapping[str, float]) -> float:
        """The positive root of sum p_a p_b exp(x s_ab) = 1 for letters of these shares, by halving."""
        names = sorted(c for c in shares if ord(c) < 256)
        p = np.array([shares[c] for c in names])
        p = p / p.sum()
        at = [ord(c) for c in names]
        s = self.matrix()[np.ix_(at, at)].astype(float)
        w = np.outer(p, p)
        if (w * s).sum() >= 0 or s.max() <= 0:
            raise ValueError("scores must be negative on average and have a positive one")
        low, high = 0.0, 1.0
        while (w * np.exp(high * s)).sum() < 1:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (w * np.exp(mid * s)).sum() < 1 else (low, mid)
        return high


def local_scores(first: list[bytes], second: list[bytes], diagonals: list[int], scoring: Scoring, band: int = BAND) -> np.ndarray:
    """Best local alignment scores with affine gaps in a band about a diagonal (place in the second less place in the first)."""
    out, table = np.zeros(len(first), np.int64), scoring.matrix()
    order, width, at = np.argsort([len(x) for x in first], kind="stable"), 2 * band + 1, 0
    while at < len(order):
        mine = order[at : at + max(1, BATCH_CELLS // width)]
        at += len(mine)
        count, rows = len(mine), max((len(first[k]) for k in mine), default=0)
        a = np.zeros((count, rows), np.uint8)
        longest = max(len(second[k]) for k in mine)
        b = np.zeros((count, longest), np.uint8)
        for x, k in enumerate(mine):
            a[x, : len(first[k])] = np.frombuffer(first[k], np.uint8)
            b[x, : len(second[k])] = np.frombuffer(second[k], np.uint8)
        na, nb = (np.array([len(s[k]) for k in mine])[:, None] for s in (first, second))
        left = np.array([diagonals[k] for k in mine])[:, None] - band + np.arange(width)
        h, gap_a, best = np.zeros((count, width), np.int32), np.full((count, width), _LOW), np.zeros(count, np.int32)
        slope, pad = np.arange(width, dtype=np.int32) * scoring.gap_more, np.full((count, 1), _LOW)
        who = np.arange(count)[:, None]
        for i in range(rows):
            j = left + i
            inside = (j >= 0) & (j < nb) & (i < na)
            if not inside.any():
                continue
            pair = table[a[:, i : i + 1], b[who, np.clip(j, 0, longest - 1)]]
            # a gap in the second sequence comes from the cell of the row above, which is one place to the right in the band
            up = np.concatenate([np.maximum(h - scoring.gap_open, gap_a - scoring.gap_more)[:, 1:], pad], 1)
            gap_a = up
            now = np.where(inside, np.maximum(np.maximum(h + pair, up), 0), 0)
            lead = np.maximum.accumulate(np.where(inside, now, _LOW) + slope, 1)
            from_left = np.concatenate([pad, lead[:, :-1]], 1) - slope - scoring.gap_open + scoring.gap_more
            h = np.where(inside, np.maximum(now, from_left), 0).astype(np.int32)
            best = np.maximum(best, h.max(1))
        out[mine] = best
    return out


def _words(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name, place, word) of all words of a length; shorter sequences have none."""
    places = F.when(F.length("sequence") >= size, F.sequence(F.lit(1), F.length("sequence") - size + 1))
    return rows.select(F.col("key").alias(name), "sequence", F.explode(places).alias("p")).select(name, (F.col("p") - 1).alias("place"), F.substring(F.col("sequence"), F.col("p"), F.lit(size)).alias("word"))


def seeds(queries: DataFrame, references: DataFrame, short: int = SHORT, long: int = LONG, frequent: int = FREQUENT) -> DataFrame:
    """(q, r, place, diagonal, size): shared words, of the short length if at most ``frequent`` references have them, else of the long one."""
    mine, theirs = _words(queries, short, "q"), _words(references, short, "r")
    count = theirs.groupBy("word").agg(F.count_distinct("r").alias("n"))
    rare = count.where(F.col("n") <= frequent).select("word")
    met = mine.join(rare, "word", "left_semi").join(theirs.withColumnRenamed("place", "to"), "word")
    out = met.select("q", "r", "place", (F.col("to") - F.col("place")).alias("diagonal"), F.lit(short).alias("size"))
    often = count.where(F.col("n") > frequent).select(F.col("word").alias("head"))
    longer = [_words(x, long, n).withColumn("head", F.substring("word", 1, short)).join(often, "head", "left_semi").drop("head") for x, n in ((queries, "q"), (references, "r"))]
    met = longer[0].join(longer[1].withColumnRenamed("place", "to"), "word")
    return out.unionByName(met.select("q", "r", "place", (F.col("to") - F.col("place")).alias("diagonal"), F.lit(long).alias("size")))


def candidates(found: DataFrame, reach: int = REACH, long: int = LONG) -> DataFrame:
    """(q, r, diagonal): pairs with a long seed or two seeds that do not overlap and lie near on one diagonal; the diagonal with most seeds."""
    line = found.where("q <> r").groupBy("q", "r", "diagonal").agg(F.array_sort(F.collect_set(F.struct("place", "size"))).alias("s"))
    gap = lambda x, y: (y["place"] - x["place"] >= x["size"]) & (y["place"] - x["place"] <= reach)
    # the seeds in reach of one are among the next few in order of place
    near = F.size(F.filter("s", lambda x, k: F.exists(F.slice("s", k + 2, F.lit(2 * reach)), lambda y: gap(x, y)))) > 0
    good = line.where(F.exists("s", lambda x: x["size"] >= long) | near)
    weight = F.aggregate("s", F.lit(0), lambda t, x: t + x["size"])
    return good.groupBy("q", "r").agg(F.max_by("diagonal", F.struct(weight.alias("w"), (-F.abs("diagonal")).alias("d"), "diagonal")).cast("int").alias("diagonal"))


def least_ids(rows: DataFrame, key: str, value: str, most: int, name: str) -> DataFrame:
    """(key, name array): the ``most`` least values of each key; copies of a hot key are dealt out first."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(value), F.lit(DEALT)))
    for part in (["_deal"], []):
        w = Window.partitionBy(key, *part).orderBy(value)
        dealt = dealt.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return dealt.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def nearest_sequences(
    queries: DataFrame,
    references: DataFrame,
    neighbours: int = 1,
    most_expected: float = 1e-3,
    scoring: Scoring | None = None,
    short: int = SHORT,
    long: int = LONG,
    frequent: int = FREQUENT,
    band: int = BAND,
    other_ids: bool = False,
) -> DataFrame:
    """(query, reference, score, bits, expected, rank): the best references of each query.

    ``queries``, ``references``: (id, sequence).  At most ``neighbours`` rows a query, by
    falling score, then by id, of those expected by chance at most ``most_expected``
    times among all letters of the references.  With ``other_ids`` a row of the same
    id is no neighbour.  Null and empty sequences have none.  Letters outside ASCII
    count as one letter.
    """
    scoring = scoring or Scoring()
    plain = lambda df: df.where(F.col("sequence").isNotNull() & (F.col("sequence") != "")).select("id", F.regexp_replace("sequence", r"[^\x00-\x7F]", "?").alias("sequence"))
    mine, theirs = plain(queries), plain(references)
    every = mine.select("sequence").unionByName(theirs.select("sequence")).distinct()
    known = written(every.select(F.monotonically_increasing_id().alias("key"), "sequence"), "search-sequences")
    q_ids = written(mine.join(known, "sequence").select("id", "key"), "search-queries")
    r_ids = written(theirs.join(known, "sequence").select("id", "key"), "search-references")
    letters = theirs.select(F.explode(F.split("sequence", "")).alias("c")).where("c <> ''").groupBy("c").count()
    shares = {r["c"]: r["count"] for r in letters.collect()}  # at most 128 letters
    schema = f"query {dict(q_ids.dtypes)['id']}, reference {dict(r_ids.dtypes)['id']}, score long, bits double, expected double, rank int"
    if not shares:
        return queries.sparkSession.createDataFrame([], schema)
    total, decay = sum(shares.values()), scoring.decay(shares)

    asked, given = known.join(q_ids.select("key").distinct(), "key", "left_semi"), known.join(r_ids.select("key").distinct(), "key", "left_semi")
    pairs = written(candidates(seeds(asked, given, short, long, frequent), REACH, long), "search-pairs")
    full = pairs.join(known.select(F.col("key").alias("q"), F.col("sequence").alias("a")), "q").join(known.select(F.col("key").alias("r"), F.col("sequence").alias("b")), "r")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([x.encode() for x in batch.column(k).to_pylist()] for k in (2, 3))
            scores = local_scores(a, b, batch.column(4).to_pylist(), scoring, band)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array([len(x) for x in a], pa.int64())], ["q", "r", "score", "size"])

    scored = full.select("q", "r", "a", "b", "diagonal").mapInArrow(work, "q long, r long, score long, size long")
    own = asked.join(given.select("key"), "key", "left_semi").select(F.col("key").alias("q"), F.col("key").alias("r"), (F.length("sequence") * scoring.same).cast("long").alias("score"), F.length("sequence").cast("long").alias("size"))
    scored = scored.unionByName(own)
    expected = F.lit(scoring.k * total) * F.col("size") * F.exp(-F.lit(decay) * F.col("score"))
    scored = scored.withColumn("expected", expected).where(F.col("expected") <= most_expected)
    return ranked(scored, q_ids, r_ids, neighbours, other_ids, decay, scoring.k)


def ranked(scored: DataFrame, q_ids: DataFrame, r_ids: DataFrame, neighbours: int, other_ids: bool, decay: float, k: float) -> DataFrame:
    """The best ids of each query from scores of distinct sequences; a sequence gives its least ids, one more than asked for."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    firsts = least_ids(r_ids.select("key", F.col("id").alias("rid")), "key", "rid", neighbours + 1, "ids").withColumn("first", F.col("ids")[0])
    some = scored.join(firsts.withColumnRenamed("key", "r"), "r").withColumn("n", F.row_number().over(best)).where(F.col("n") <= neighbours + 1)
    # of each distinct query the rows that any of its ids can need: few, whatever its copies
    rows = some.select("q", "score", "expected", F.explode("ids").alias("reference"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "reference", "expected")))
    lists = written(rows.groupBy("q").agg(order.alias("hits")), "search-hits")
    out = q_ids.join(lists, F.col("key") == F.col("q")).select(F.col("id").alias("query"), "hits")
    kept: Column = F.filter("hits", lambda h: h["reference"] != F.col("query")) if other_ids else F.col("hits")
    out = out.select("query", F.posexplode(F.slice(kept, 1, neighbours)).alias("at", "h"))
    score = -F.col("h.s")
    return out.select("query", F.col("h.reference").alias("reference"), score.alias("score"), ((F.lit(decay) * score - math.log(k)) / math.log(2)).alias("bits"), F.col("h.expected").alias("expected"), (F.col("at") + 1).alias("rank"))
