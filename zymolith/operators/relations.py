"""Row selection, joins, sampling and set operations with explicit order and null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..functions.running import ordinals

# --- first and last rows -------------------------------------------------------------------


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that comes first in ``order`` for each key, as an aggregate: no sort of hot keys."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def last_value_per_key(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, value) of the row that comes last; null keys are dropped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- joins -----------------------------------------------------------------------------------


def semi(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*on).distinct(), list(on), "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner; null keys have none and stay."""
    return df.join(ids.select(*on).distinct(), list(on), "left_anti")


def replace_column(df: DataFrame, other: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Inner join on keys where null equals null; ``column`` comes from ``other``."""
    right = other.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col(column))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.drop(column).join(right, cond).drop(*[f"_k_{c}" for c in on])


def mean_vector(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row with the element-wise mean of an array column."""
    parts = vectors.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean_vector"))


def left_impute_mean(ids: DataFrame, vectors: DataFrame, on: str, column: str = "embedding") -> DataFrame:
    """Left join; ids without a vector get the mean vector (one row, so it is broadcast)."""
    doubles = vectors.select(on, F.col(column).cast("array<double>").alias(column))
    joined = ids.join(doubles, on, "left").crossJoin(F.broadcast(mean_vector(vectors, column)))
    return joined.withColumn(column, F.coalesce(column, "mean_vector")).drop("mean_vector")


def left_impute_zero(ids: DataFrame, vectors: DataFrame, on: str, column: str, size: int) -> DataFrame:
    doubles = vectors.select(on, F.col(column).cast("array<double>").alias(column))
    return ids.join(doubles, on, "left").withColumn(column, F.coalesce(column, F.array_repeat(F.lit(0.0), size)))


def with_zero_rows(features: DataFrame, ids: DataFrame, on: str, column: str, size: int) -> DataFrame:
    """``features`` plus a zero vector for each id that has none."""
    missing = anti(ids.select(on).distinct(), features, [on])
    return features.select(on, column).unionByName(missing.select(on, F.array_repeat(F.lit(0.0), size).alias(column)))


def lookup_chain(classes: DataFrame, reactions: DataFrame, directed: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, substrates): class -> reaction -> directed reaction, else itself -> the text before ``>>``, split at dots."""
    chain = classes.join(reactions, "class").join(directed, "reaction", "left").withColumn("reaction", F.coalesce("directed", "reaction"))
    parts = chain.join(texts, "reaction").select("class", F.explode(reactants("text")).alias("substrate"))
    return parts.groupBy("class").agg(F.array_sort(F.collect_set("substrate")).alias("substrates"))


def reactants(column: str) -> Column:
    return F.split(F.split(F.col(column), ">>")[0], r"\.")


def set_overlap(hits: DataFrame, class_sets: DataFrame, known: DataFrame) -> DataFrame:
    """(id, substrate, conf): classes whose substrates meet the known ones give a row a shared substrate; the last class wins."""
    shared = class_sets.select("class", F.explode("substrates").alias("substrate")).join(known.distinct(), "substrate", "left_semi")
    return hits.join(shared, "class").groupBy("id", "substrate").agg(F.max_by("conf", "ordinal").alias("conf"))


def recall_overlap(new: DataFrame, known: DataFrame, keys: Sequence[str], item: str, share: float = 0.5) -> DataFrame:
    """(keys, new_id, known_id): new sets of which at least ``share`` lies in a known set.

    ``new`` and ``known`` have a row an item, with ids ``new_id`` and ``known_id``.  The
    share is of the new set only, so it is not symmetric; empty sets meet nothing.
    """
    sizes = new.groupBy(*keys, "new_id").agg(F.countDistinct(item).alias("size"))
    common = new.select(*keys, "new_id", item).distinct().join(known.select(*keys, "known_id", item).distinct(), [*keys, item])
    counts = common.groupBy(*keys, "new_id", "known_id").count().join(sizes, [*keys, "new_id"])
    return counts.where(F.col("count") / F.col("size") >= share).select(*keys, "new_id", "known_id")


def priority_merge(items: DataFrame, priorities: Sequence[str], keys: Sequence[str], group: str, set_id: str, item: str, share: float = 0.5) -> DataFrame:
    """Sets kept when groups are merged in order of priority.

    A set of a group is dropped if it overlaps (by recall) a kept set of an earlier
    group; sets of one group do not compete.  Which sets overlap is found once, over
    all groups; the steps, one a group, then work on pairs of sets only.
    """
    names = list(priorities)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(group))
    mine = written(items.where(F.col(group).isin(*names)), "merge-items")
    rows = mine.select(*keys, place.alias("_g"), F.col(set_id).alias("_s"), item).distinct()
    sizes = rows.groupBy(*keys, "_g", "_s").agg(F.count(F.lit(1)).alias("size"))
    other = rows.select(*keys, F.col("_g").alias("_h"), F.col("_s").alias("_t"), item)
    common = rows.join(other, [*keys, item]).where("_h < _g").groupBy(*keys, "_g", "_s", "_h", "_t").agg(F.count(F.lit(1)).alias("n"))
    clash = common.join(sizes, [*keys, "_g", "_s"]).where(F.col("n") / F.col("size") >= share).select(*keys, "_g", "_s", "_h", "_t")
    clash = written(clash, "merge-clashes")
    gone = None
    for k in range(2, len(names) + 1):
        step = clash.where(F.col("_g") == k)
        if gone is not None:
            dropped = gone.select(*keys, F.col("_g").alias("_h"), F.col("_s").alias("_t"))
            step = step.join(dropped, [*keys, "_h", "_t"], "left_anti")
        step = written(step.select(*keys, "_g", "_s").distinct(), "merge-dropped")
        gone = step if gone is None else gone.unionByName(step)
    if gone is None:
        return mine
    gone = gone.select(*keys, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_g").cast("int")).alias(group), F.col("_s").alias(set_id))
    return mine.join(gone, [*keys, group, set_id], "left_anti").select(*items.columns)


# --- folds, sets, sampling -------------------------------------------------------------------


def other_folds(df: DataFrame, fold, column: str = "fold") -> DataFrame:
    return df.where(F.col(column) != fold)


def assert_disjoint(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    """Raises if the two share a key: leaked ids."""
    if not left.select(*on).join(right.select(*on), list(on), "left_semi").isEmpty():
        raise ValueError(f"ids are shared between the sides: {', '.join(on)}")


def hashed(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 2**31) that depends on the columns and the seed only, the same in any engine.

    A multiplicative hash of CRC32, so SQL can state it.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.pmod(F.crc32(text) * F.lit(2654435761), F.lit(2147483648))


def uniform_sample(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, by a keyed hash of the id: the same rows in every run.

    The rows with the least hashes.  A histogram of 2**16 cells of the hash says up
    to which cell all rows are taken; only that cell is cut by order.
    """
    keyed = df.withColumn("_h", F.xxhash64(F.lit(seed), *id_cols)).withColumn("_cell", F.shiftright("_h", 48))
    left, last = n, None
    for r in sorted(keyed.groupBy("_cell").count().collect()):
        if r["count"] > left:
            last = r["_cell"]
            break
        left -= r["count"]
    if last is None:
        return df
    rest = keyed.where(F.col("_cell") == last).orderBy("_h", *id_cols).limit(left)
    return keyed.where(F.col("_cell") < last).unionByName(rest).drop("_h", "_cell")


def downsample_negatives(df: DataFrame, positive: Column, share: float, id_col: str, order: Column) -> DataFrame:
    """All positives and so many negatives, the first by ``order``, that these make up at most ``share``: int(pos / (1 - share) - pos)."""
    flagged = df.withColumn("_pos", positive)
    n = flagged.where("_pos").select(id_col).distinct().count()
    most = int(n / (1 - share) - n)
    ranked = ordinals(flagged.where("not _pos").withColumn("_order", order), ["_order", id_col], "_at")
    return flagged.where("_pos").unionByName(ranked.where(F.col("_at") < most).drop("_order", "_at")).drop("_pos")


def carry_forward_sample(df: DataFrame, ordinal: str, blacklisted: str, selected: str) -> DataFrame:
    """Rows of a sample in which a blacklisted selected row hands its place to the next row.

    Taken are selected rows that are not blacklisted, and rows that are not
    blacklisted and whose predecessor is both blacklisted and selected.  A place
    handed to a row that was selected anyway, or that meets an unselected
    blacklisted row, is lost.  Ordinals must be dense; predecessors are joined, not
    windowed, so any number of rows is spread over all tasks.
    """
    flags = df.select((F.col(ordinal) + 1).alias(ordinal), (F.col(blacklisted) & F.col(selected)).alias("_gives"))
    rows = df.join(flags, ordinal, "left")
    return rows.where(~F.col(blacklisted) & (F.col(selected) | F.coalesce("_gives", F.lit(False)))).drop("_gives")


def ordinal_range(df: DataFrame, ordinal: str, start: int, end: int) -> DataFrame:
    """Half-open [start, end)."""
    return df.where((F.col(ordinal) >= start) & (F.col(ordinal) < end))


def melted(df: DataFrame, ids: Sequence[str], flags: Sequence[str], name: str = "class") -> DataFrame:
    """Long form of 0/1 columns, ones only."""
    return df.unpivot(list(ids), list(flags), name, "_flag").where("_flag = 1").drop("_flag")


def pivoted(df: DataFrame, ids: Sequence[str], name: str, values: Sequence[str], value: str, default=0.0) -> DataFrame:
    """Wide form over listed ``values``, so the plan needs no pass to find them."""
    out = df.groupBy(*ids).pivot(name, list(values)).agg(F.max(value))
    return out.na.fill(default, list(values))


def unprocessed(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return anti(df, done, on)


def union_of_top_k(df: DataFrame, fold: str, item: str, importance: str, k: int) -> DataFrame:
    """Items that are among the ``k`` most important ones of any fold."""
    return top_k(df, [fold], [F.desc(importance), F.asc(item)], k).select(item).distinct()
