"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, divided by its quality weight, from a
keyed hash.  Complete epochs of a source come first; what is left of its target
is taken from its documents in the order of their keys up to the word budget.
Prefix sums are distributed: rows are range-partitioned by (source, key), each
part is summed, and a row adds the sum of the parts before it to the sum in its
own part.  So a source of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import in_parts, ordinals
from .shared import empty_text, small_side, written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources or parts of more rows than this are joined by a shuffle.
BROADCAST_ROWS = 1 << 18


def symbol_quality(text: Column) -> Column:
    """A quality weight in [0.05, 1]: low where markup and symbols are frequent."""
    odd = F.length(text) - F.length(F.translate(text, "#$%&*|<>{}[]^~@\\_", ""))
    return F.greatest(F.lit(0.05), 1 - 4 * odd / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: Sequence[float], most_epochs: int) -> DataFrame:
    """(k, source_size, target) for ``sizes`` (k, source_size), one row a source.

    Weights repeat over the sources in the order of ``k``.  The targets share
    the total by weight; one that would pass ``most_epochs`` times its source's
    size stops there, and the excess is shared by weight among the others, until
    none is above.  With caps in the order of cap / weight, the level that the
    others reach is the largest of (total - caps before) / (weights from here).

    Sources are numbered and summed in ranges of their order, so there may be as
    many as hosts of a crawl; only the level, one number, comes to the driver.
    """
    place = ordinals(written(sizes, "mix-sources"), ["k"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    rows = place.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    rows = in_parts(rows.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "k"])
    ranges = rows.groupBy("_part").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.sum("source_size").alias("size"))
    order = Window.orderBy("_part")  # one row a range
    ranges = ranges.select(
        "_part",
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)).alias("weights_after"),
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("_part").orderBy("ratio", "k")
    before = F.coalesce(F.sum("cap").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(within.rowsBetween(0, Window.unboundedFollowing))
    own = rows.withColumn("before", before).withColumn("onward", onward).join(F.broadcast(ranges), "_part")
    level = (F.col("total") - F.col("caps_before") - F.col("before")) / (F.col("weights_after") + F.col("onward"))
    level = F.lit(own.agg(F.max(level)).first()[0]).cast("double")
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("k", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most_epochs: int = 3,
    seed: int = 20240607,
    quality: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of ``docs``.

    ``size``: words ``[^\\x20\\x09-\\x0D]+`` of the text; ``taken``: words that the mix
    takes, repeats counted: the size times the complete epochs, plus the size
    again for documents whose turn comes within what is left of the target.  The
    document on which the budget ends is taken in part, so a source's sum misses
    its target by less than one word; none exceeds ``most_epochs`` times its size.

    Null or empty text: size 0, taken 0.  Null source: a source of its own, last
    in order.  Null or repeated ids: keys also depend on the text; fully equal
    rows tie and are interchangeable.  Other columns are ignored.  An empty
    table gives an empty result.
    """
    text = empty_text(text_col)
    weight = symbol_quality(text) if quality is None else quality
    # strings sort by code point; null comes after all
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("2")).alias("k"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("u"),
        weight.alias("q"),
    )
    uniform = (F.shiftrightunsigned("u", 11).cast("double") + 0.5) / float(2**53)
    rows = rows.withColumn("turn", -F.log(uniform) / F.col("q")).drop("q")
    # one pass over the texts: from here on rows are narrow
    placed = written(rows, "mix-rows").repartitionByRange("k", "turn", "u").withColumn("part", F.spark_partition_id())
    placed = written(placed, "mix-parts")
    parts = placed.groupBy("k", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("k", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    targets = source_targets(placed.groupBy("k").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    known = written(parts.join(targets, "k"), "mix-targets")
    within = Window.partitionBy("part", "k").orderBy("turn", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = out.join(small_side(known, BROADCAST_ROWS), ["k", "part"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    out = out.withColumn("epochs", epochs)
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("ahead") - F.col("own")))
    out = out.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")
