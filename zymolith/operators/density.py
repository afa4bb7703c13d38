"""Density clusters of vectors without their matrix of distances.

Core distances and lists of neighbours come from pairs of packs.  The least
spanning tree of mutual reachability grows in rounds: every component takes its
least edge to another.  Where a component's list of neighbours proves that edge, no
distance is computed; the items of other components are compared with all
packs again, a tile of distances at a time.  The edges of the finished tree, one less
than items, are sorted and condensed in one task: linear, as any listing of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import exact, tiles
from ..functions.scratch import written
from . import blocks as B
from .clustering import labels_of_tree


def neighbours(items: DataFrame, k: int, blocks: int) -> DataFrame:
    """(i, near array<struct<d, j>>): the ``k`` nearest others of each item (id, x), by distance, then id."""
    found = B.nearest(B.packed(items, "x", packs=blocks), k)
    return found.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))


def _least_edges(open_items: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """(comp, w, lo, hi): the least mutual-reachability edge from each component of ``open_items`` (id, x, core, comp) to another one."""

    def call(left: B.Pack, right: B.Pack) -> Iterator[pa.Table]:
        comps, place = np.unique(left.rest["comp"], return_inverse=True)
        least, found = np.full(len(comps), np.inf), {}
        for r, c, d in tiles(left.x, right.x):
            w = np.maximum(d, left.rest["core"][r, None])
            np.maximum(w, right.rest["core"][c], out=w)
            w[left.rest["comp"][r, None] == right.rest["comp"][c]] = np.inf
            low, own = w.min(1), place[r]
            for x in np.flatnonzero(np.isfinite(low) & (low <= least[own] * (1 + 1e-9) + 1e-12)):
                # by differences, which are the same from either end and in the lists of neighbours
                near = np.flatnonzero(w[x] <= low[x] * (1 + 1e-9) + 1e-12)
                js, i = right.ids[c][near], left.ids[r][x]
                reach = np.maximum(np.maximum(exact(left.x[r][x], right.x[c][near]), left.rest["core"][r][x]), right.rest["core"][c][near])
                edge = min(zip(reach.tolist(), np.minimum(i, js).tolist(), np.maximum(i, js).tolist(), strict=True))
                found[own[x]] = min(found.get(own[x], edge), edge)
                least[own[x]] = found[own[x]][0]
        rows = sorted((int(comps[k]), e) for k, e in found.items())
        yield pa.table({"comp": pa.array([c for c, _ in rows], pa.int64()), "w": pa.array([e[0] for _, e in rows], pa.float64()), "lo": pa.array([e[1] for _, e in rows], pa.int64()), "hi": pa.array([e[2] for _, e in rows], pa.int64())})

    asked, other = (B.packed(rows, "x", rest=["core", "comp"], packs=blocks) for rows in (open_items, items))
    return B.over_pairs(asked, call, "comp long, w double, lo long, hi long", other)


def spanning_tree(items: DataFrame, least: int, blocks: int, listed: int) -> DataFrame:
    """(w, lo, hi): the least spanning tree of mutual reachability of (id, x), ties by the ends of an edge."""
    near = written(neighbours(items, max(listed, least), blocks), "density-near")
    # the item itself counts among its ``least`` nearest; with fewer items the farthest one stands for it
    core = F.coalesce(F.try_element_at("near", F.lit(least - 1)), F.try_element_at("near", F.lit(-1)))["d"] if least > 1 else F.lit(0.0)
    state = items.join(near.select(F.col("i").alias("id"), "near"), "id", "left").select("id", "x", F.coalesce(core, F.lit(0.0)).alias("core"), F.col("id").alias("comp"), F.try_element_at("near", F.lit(-1))["d"].alias("bound"))
    state = written(state, "density-items")
    cores = state.select(F.col("id").alias("j"), F.col("core").alias("core_j"))
    lists = near.select("i", F.explode("near").alias("n")).select("i", "n.d", "n.j").join(cores, "j").join(cores.select(F.col("j").alias("i"), F.col("core_j").alias("core_i")), "i")
    lists = written(lists.select("i", "j", F.greatest("d", "core_i", "core_j").alias("w")), "density-lists")
    tree = None
    while True:
        comp = state.select("id", "comp")
        ends = lists.join(comp.select(F.col("id").alias("i"), F.col("comp").alias("ci")), "i").join(comp.select(F.col("id").alias("j"), F.col("comp").alias("cj")), "j").where("ci <> cj")
        edge = F.struct("w", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
        from_lists = ends.groupBy(F.col("ci").alias("comp")).agg(F.min(edge).alias("e"))
        # whatever is in no list is at least as far as the end of the list of its item: strictly below that, the listed edge is the least
        limits = state.groupBy("comp").agg(F.min(F.greatest("bound", "core")).alias("bound"))
        judged = limits.join(from_lists, "comp", "left").withColumn("proven", F.coalesce(F.col("e.w") < F.col("bound"), F.lit(False)))
        judged = written(judged, "density-judged")
        if judged.limit(2).count() < 2:
            break
        proven = judged.where("proven").select("comp", "e.w", "e.lo", "e.hi")
        open_items = state.join(judged.where("not proven").select("comp"), "comp", "left_semi").select("id", "x", "core", "comp")
        scanned = _least_edges(open_items, state.select("id", "x", "core", "comp"), blocks)
        chosen = proven.unionByName(scanned).groupBy("comp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("comp", "e.*")
        new = written(chosen.select("w", "lo", "hi").distinct(), "density-edges")
        tree = new if tree is None else tree.unionByName(new)
        state = written(_joined(state, new), "density-items")
    return tree


def _joined(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Items with the components that the edges join: the least component's number, by hooking and jumping."""
    comp = state.select("id", "comp")
    links = edges.join(comp.select(F.col("id").alias("lo"), F.col("comp").alias("a")), "lo").join(comp.select(F.col("id").alias("hi"), F.col("comp").alias("b")), "hi").select("a", "b")
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "density-links")
    name = written(comp.select(F.col("comp").alias("a"), F.col("comp").alias("to")).distinct(), "density-names")
    while True:
        least = links.join(name.select(F.col("a").alias("b"), F.col("to").alias("t")), "b").groupBy("a").agg(F.min("t").alias("t"))
        hooked = name.join(least, "a", "left").select("a", F.least("to", F.coalesce("t", "to")).alias("to"))
        # a component takes the name of its name
        jumped = hooked.join(hooked.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.least("to", "far").alias("to"))
        after = written(jumped, "density-names")
        changed = not after.join(name.withColumnRenamed("to", "was"), "a").where("to <> was").isEmpty()
        name = after
        if not changed:
            break
    return state.join(name.select(F.col("a").alias("comp"), "to"), "comp").select("id", "x", "core", F.col("to").alias("comp"), "bound")


def density_clusters(vectors: DataFrame, least: int = 5, vector: str = "embedding", id_col: str = "id", blocks: int | None = None, listed: int | None = None) -> DataFrame:
    """(id, cluster): HDBSCAN clusters of vectors of one length by Euclidean distance; -1 is noise.

    ``listed``: neighbours kept of each item, at least ``least``; more of them prove more
    edges.  Ids are whole numbers, each once.  Fewer than two items are noise.
    """
    items = written(vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")), "density-vectors")
    n = items.count()
    if n < 2:
        return items.select("id", F.lit(-1).cast("long").alias("cluster"))
    blocks = blocks or B.pack_count(n)
    tree = spanning_tree(items, least, blocks, listed or 4 * least)

    def call(edges: pa.Table) -> pa.Table:
        lo, hi = edges["lo"].to_numpy(), edges["hi"].to_numpy()
        ids = np.unique(np.concatenate([lo, hi]))
        rows = sorted(zip(edges["w"].to_numpy().tolist(), np.searchsorted(ids, lo).tolist(), np.searchsorted(ids, hi).tolist(), strict=True))
        return pa.table({"id": ids, "cluster": labels_of_tree(len(ids), rows, least).astype(np.int64)})

    return tree.groupBy().applyInArrow(call, "id long, cluster long")
