"""Group folds: balanced, stratified and without leaked groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def group_ids(examples: DataFrame, clades: DataFrame, majors: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds ``group``: the clade of an id that has one and a major class, else the id itself; a null id that of its row's values, the same in every run."""
    out = examples.join(clades.select(id_col, "clade"), id_col, "left").join(majors.select(id_col).distinct().withColumn("_major", F.lit(True)), id_col, "left")
    clade = F.when(F.col("_major") & F.col("clade").isNotNull(), F.concat(F.lit("clade-"), F.col("clade").cast("string")))
    alone = F.coalesce(F.concat(F.lit("id-"), F.col(id_col).cast("string")), F.concat(F.lit("row-"), F.hex(F.xxhash64(*examples.columns))))
    return out.withColumn("group", F.coalesce(clade, alone)).drop("clade", "_major")


def group_counts(examples: DataFrame, group: str = "group", label: str = "label") -> DataFrame:
    """(group, label, n): all that fold assignment needs of the examples."""
    return examples.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))


def _divergence(folds: list[dict], total: dict) -> float:
    from math import log, sqrt

    whole, out = sum(total.values()), 0.0
    for f in folds:
        size, s = sum(f.values()), 0.0
        for k, n in total.items():
            p, q = (f.get(k, 0) / size if size else 0.0), n / whole
            m = (p + q) / 2
            s += (p * log(p / m) if p else 0) / 2 + (q * log(q / m) if q else 0) / 2
        out += sqrt(max(s, 0.0))
    return out / len(folds)


def _assign(groups: list[tuple[str, dict]], folds: int, seed: int) -> tuple[float, dict[str, int]]:
    """Greedy: large groups first, each to the fold where class shares then spread least; ties by fold size."""
    import hashlib

    total: dict = {}
    for _, c in groups:
        for k, n in c.items():
            total[k] = total.get(k, 0) + n
    noise = lambda g: hashlib.blake2b(f"{seed}|{g}".encode(), digest_size=8).digest()
    order = sorted(groups, key=lambda x: (-sum(x[1].values()), noise(x[0])))
    sums: list[dict] = [{} for _ in range(folds)]
    place = {}
    for g, c in order:
        def cost(f: int) -> tuple:
            spread = 0.0
            for k, n in c.items():
                shares = [(s.get(k, 0) + (n if j == f else 0)) / total[k] for j, s in enumerate(sums)]
                mean = sum(shares) / folds
                spread += sum((x - mean) ** 2 for x in shares)
            return spread, sum(sums[f].values()), f

        best = min(range(folds), key=cost)
        place[g] = best
        for k, n in c.items():
            sums[best][k] = sums[best].get(k, 0) + n
    return _divergence(sums, total), place


def group_kfold(counts: DataFrame, folds: int = 5, seeds: int = 100, group: str = "group", label: str = "label") -> DataFrame:
    """(group, fold): of ``seeds`` greedy assignments the one with the least mean Jensen-Shannon distance to the whole.

    Works on the (group, label, n) summary, which is broadcast; seeds run in
    parallel.  Where it has more rows than MAX_GROUPS, groups that hold a small
    share of each of their labels are bundled by hash, and the same search places
    the bundles and the other groups: what is broadcast grows with the labels then,
    not with the groups.
    """
    spark = counts.sparkSession
    if counts.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        return _bundled_kfold(counts, folds, seeds, group, label)
    best = _search(spark, counts.select(group, label, "n").collect(), folds, seeds)
    return spark.createDataFrame(list(best.items()), f"{group} {dict(counts.dtypes)[group]}, fold int")


def _bundled_kfold(counts: DataFrame, folds: int, seeds: int, group: str, label: str) -> DataFrame:
    spark = counts.sparkSession
    own = counts.select(F.col(group).alias("_g"), F.col(label).alias("_l"), "n")
    totals = own.groupBy(F.col("_l").alias("_of")).agg(F.sum("n").alias("_total"))
    # a label has at most so many groups that hold 1 / parts of it, and so many bundles
    parts = max(20 * folds, MAX_GROUPS // (2 * totals.count()))
    large = own.join(totals, F.col("_l").eqNullSafe(F.col("_of"))).where(F.col("n") * parts >= F.col("_total"))
    large = large.select(F.col("_g").alias("_large")).distinct()
    bundle = F.when(F.col("_large").isNotNull(), -1).otherwise(F.pmod(F.xxhash64("_g"), F.lit(parts))).cast("long")
    own = own.join(large, F.col("_g") == F.col("_large"), "left").withColumn("_bundle", bundle)
    rows = own.groupBy("_bundle", "_large", "_l").agg(F.sum("n").alias("n")).collect()
    best = _search(spark, [((r["_bundle"], r["_large"]), r["_l"], r["n"]) for r in rows], folds, seeds)
    kind = dict(counts.dtypes)[group]
    placed = spark.createDataFrame([(b, g, f) for (b, g), f in best.items()], f"_b long, _own {kind}, fold int")
    same = (F.col("_bundle") == F.col("_b")) & F.col("_large").eqNullSafe(F.col("_own"))
    groups = own.select(F.col("_g"), "_bundle", "_large").distinct()
    return groups.join(F.broadcast(placed), same).select(F.col("_g").alias(group), "fold")


def _search(spark: SparkSession, rows: list, folds: int, seeds: int) -> dict:
    """The fold of each group of the (group, label, n) rows."""
    table: dict = {}
    for g, k, n in rows:
        table.setdefault(g, {})[k] = n
    groups = sorted(table.items())
    sent = spark.sparkContext.broadcast(groups)

    def trial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(int(s), _assign(sent.value, folds, int(s))[0]) for s in b["id"]], columns=["seed", "js"])

    best = spark.range(0, seeds, 1, min(seeds, 32)).mapInPandas(trial, "seed long, js double").orderBy("js", "seed").first()["seed"]
    return _assign(groups, folds, best)[1]


#: Rows of the (group, label) summary up to which each group is placed by itself.
MAX_GROUPS = 200_000


def stratified_kfold(df: DataFrame, folds: int, id_col: str, stratum: Column, seed: int = 0) -> DataFrame:
    """Adds ``fold``: the ids of a stratum in keyed order, dealt out in turn.

    Ordinals come from range-sorted parts, so a stratum of any size is spread.
    """
    from ..functions.running import running_sums

    rows = df.select(F.col(id_col), stratum.alias("_s"), F.xxhash64(F.lit(seed), id_col).alias("_h")).distinct().withColumn("_one", F.lit(1))
    placed = running_sums(rows.groupBy("_s", "_h").agg(F.sum("_one").alias("_one"), F.min(id_col).alias("_first")), ["_s"], "_h", {"_n": "_one"})
    return df.withColumns({"_s": stratum, "_h": F.xxhash64(F.lit(seed), id_col)}).join(placed.select("_s", "_h", (F.pmod("_n", F.lit(folds))).cast("int").alias("fold")), ["_s", "_h"]).drop("_s", "_h")
