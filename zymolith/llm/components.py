"""Connected components of an edge table, by large and small stars in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


#: Edges up to which a round is one plan.
SMALL_EDGES = 1 << 18


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v): component is the least node that is reached.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least node around it, until the edges are stars.  Rounds grow with the
    logarithm of the longest path.  Least neighbours are aggregated before the
    shuffle and joined back, so a node with very many neighbours is no hot group.
    Every round is written to the shared folder.  The least neighbours of up to
    SMALL_EDGES edges are broadcast, so no node's edges meet in one task; of more
    edges the steps are written too, so that adaptive execution splits hot keys.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if digest[0] > SMALL_EDGES else df

    def at_hand(least: DataFrame) -> DataFrame:
        return least if digest[0] > SMALL_EDGES else F.broadcast(least)

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = _digest(now)
    while digest[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # larger neighbours of u go to the least node around u
        large = now.select(F.col("u").alias("x"), F.col("v").alias("u")).join(at_hand(least), "u").select(F.col("x").alias("u"), F.col("m").alias("v"))
        large = kept(large.distinct(), "edges")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # smaller neighbours of u, and u, go to the least of them
        small = large.join(at_hand(least), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        was, digest = digest, _digest(now)
        if was == digest:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
