"""Trees as edge tables (node, parent, length): depths and clusters of leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import ordinals
from ..functions.scratch import written


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iterative plan."""
    return written(df, "tree")


def max_depths(edges: DataFrame) -> DataFrame:
    """(node, parent, depth): own length plus the greatest depth below; null lengths are 0.

    By doubling: after round k a node knows the greatest depth within 2**k levels
    below it, its ancestor 2**k levels up, and the length of the way to it.  A round
    adds to a node the depths that its descendants 2**k levels down know, so rounds
    grow with the logarithm of the height, and a chain costs no more than a bush.
    """
    nodes = edges.select("node", "parent", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"))
    above = nodes.select(F.col("node").alias("parent"), F.col("node").alias("up"), F.col("length").alias("way"))
    now = _cut(nodes.join(above, "parent", "left").select("node", "parent", F.col("length").alias("depth"), "up", "way"))
    rounds = now.count().bit_length() + 1
    while not now.where("up is not null").isEmpty():
        if not rounds:
            raise ValueError("the edges are no tree")
        rounds -= 1
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.max(F.col("depth") + F.col("way")).alias("below"))
        further = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("way").alias("way2"))
        depth = F.greatest("depth", F.coalesce("below", "depth")).alias("depth")
        now = _cut(now.join(below, "node", "left").join(further, "up", "left").select("node", "parent", depth, F.col("up2").alias("up"), (F.col("way") + F.col("way2")).alias("way")))
    return now.select("node", "parent", "depth")


def clade_clusters(edges: DataFrame, limit: float) -> DataFrame:
    """(leaf, root): the highest ancestor that is reached through depths below ``limit`` only; else the leaf itself.

    The root of the tree may be reached too.  Clusters are named by their root.
    Ancestors are found by pointer doubling, so rounds grow with the logarithm of the
    height.
    """
    depth = max_depths(edges)
    ok = depth.select(F.col("node").alias("parent"), (F.round("depth", 12) < limit).alias("open"))
    step = depth.join(ok, "parent", "left").select("node", F.when(F.coalesce("open", F.lit(False)), F.col("parent")).otherwise(F.col("node")).alias("up"))
    step = _cut(step)
    while True:
        further = _cut(step.join(step.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")))
        moved = not further.join(step, ["node", "up"], "left_anti").isEmpty()
        step = further
        if not moved:
            break
    leaves = edges.join(edges.select(F.col("parent").alias("node")).where(F.col("node").isNotNull()).distinct(), "node", "left_anti")
    return step.join(leaves.select("node"), "node", "left_semi").select(F.col("node").alias("leaf"), F.col("up").alias("root"))


def numbered(clusters: DataFrame, order: str = "leaf") -> DataFrame:
    """(leaf, cluster): clusters numbered from 0 in falling order of their last leaf."""
    last = clusters.groupBy("root").agg(F.max(order).alias("last"))
    numbers = ordinals(last, [F.desc("last")], "cluster")
    return clusters.join(numbers, "root").select("leaf", "cluster")
