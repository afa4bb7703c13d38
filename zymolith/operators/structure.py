"""Domain detection over residues: thresholds, overlaps, assignment of segments, alignment scores.

Regions are rows (file, module_id, domain, score, residues map<int,int>); the value
-1 of a residue means that it was assigned by nearness.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import TEMPLATES
from ..functions.sides import small_side
from .relations import priority_merge
from .segments import has_long_segment, islands, longest_segment, parse_selection

# Least score and size of each domain, and the order in which domains are assigned.
THRESHOLDS = {"alpha": (0.35, 130), "beta": (0.60, 50), "gamma": (0.55, 50), "delta": (0.60, 50), "epsilon": (0.60, 50)}
PRIORITY = ("alpha", "epsilon", "delta", "beta", "gamma")
NEAR, CLEARLY = 17.0, 0.9


def thresholds(spark: SparkSession) -> DataFrame:
    rows = [(d, s, n) for d, (s, n) in THRESHOLDS.items()]
    return spark.createDataFrame(rows, "domain string, least_score double, least_size int")


def templates(spark: SparkSession) -> DataFrame:
    """(domain, file, residue): the residues of each domain's template; null for all residues of the file."""
    rows = spark.createDataFrame([(d, f, r) for d, (f, r) in TEMPLATES.items()], "domain string, file string, selection string")
    residues = F.when(F.col("selection").isNotNull(), parse_selection(F.col("selection")))
    return rows.select("domain", "file", F.explode_outer(residues).alias("residue"))


def with_third_pass(completed_regions: DataFrame, found_later: DataFrame, include: bool = True) -> DataFrame:
    """Completed regions, and those found on the residues that remained, if they are wanted."""
    return completed_regions.unionByName(found_later.join(completed_regions.select("file", "module_id"), ["file", "module_id"], "left_anti")) if include else completed_regions


def size(column: str = "residues") -> Column:
    return F.size(F.map_keys(column))


def alignments_kept(regions: DataFrame, limits: DataFrame, with_size: bool = True) -> DataFrame:
    """Candidates at or above both thresholds of their domain."""
    keep = F.col("score") >= F.col("least_score")
    if with_size:
        keep = keep & (size() >= F.col("least_size"))
    return regions.join(small_side(limits), "domain").where(keep).select(*regions.columns)


def mapped_regions(regions: DataFrame, limits: DataFrame) -> DataFrame:
    """Candidates above the score threshold and at or above the size: stricter than ``alignments_kept`` on ties."""
    keep = (F.col("score") > F.col("least_score")) & (size() >= F.col("least_size"))
    return regions.join(small_side(limits), "domain").where(keep).select(*regions.columns)


def residues_of(regions: DataFrame) -> DataFrame:
    """(file, module_id, domain, residue): one row a residue."""
    return regions.select("file", "module_id", "domain", F.explode(F.map_keys("residues")).alias("residue"))


def remaining(all_residues: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, residue) in no region."""
    return all_residues.select("file", "residue").join(residues_of(regions).select("file", "residue").distinct(), ["file", "residue"], "left_anti")


def detect_domains(candidates: DataFrame, limits: DataFrame, priority: Sequence[str] = PRIORITY, share: float = 0.5) -> DataFrame:
    """Regions kept when domains are assigned in order; a candidate that overlaps an earlier domain's goes."""
    good = alignments_kept(candidates, limits, with_size=False)
    kept = priority_merge(residues_of(good), priority, ["file"], "domain", "module_id", "residue", share)
    return good.join(kept.select("file", "module_id").distinct(), ["file", "module_id"], "left_semi")


def confident_only(regions: DataFrame, confident: DataFrame) -> DataFrame:
    """Region maps cut to confident residues, as a semi join of their entries."""
    rows = regions.select("file", "module_id", F.explode("residues").alias("residue", "to"))
    kept = rows.join(confident, ["file", "residue"], "left_semi").groupBy("file", "module_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("residue", "to")))).alias("residues"))
    return regions.drop("residues").join(kept, ["file", "module_id"])


def could_hold_another(all_residues: DataFrame, regions: DataFrame, least: int = 50, gap: int = 5) -> DataFrame:
    """Files without an alpha region and more than ``least`` remaining residues, or with a long remaining segment."""
    left = remaining(all_residues, regions)
    alpha = regions.where("domain = 'alpha'").select("file").distinct()
    many = left.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("file").join(alpha, "file", "left_anti")
    return many.unionByName(has_long_segment(left, ["file"], least, gap, "residue")).distinct()


def longest_unmapped(all_residues: DataFrame, regions: DataFrame, domains: Sequence[str], gap: int = 5) -> DataFrame:
    """(file, residue) of the longest segment outside the regions of ``domains``."""
    some = regions.where(F.col("domain").isin(*domains))
    blocked = residues_of(some).select("file", "residue").distinct()
    return longest_segment(remaining(all_residues, some), blocked, ["file"], gap, "residue")


def nearest_regions(atoms: DataFrame, segments: DataFrame, region_residues: DataFrame, near: float = NEAR, clearly: float = CLEARLY) -> DataFrame:
    """(file, segment, module_id, distance): unassigned segments with a region nearer than ``near`` and clearly nearest.

    ``atoms``: (file, residue, x, y, z); ``segments``: (file, segment, residue);
    ``region_residues``: (file, module_id, residue).  Distances are between
    centroids; the nearest must be below ``clearly`` times the next distinct one.
    Centroids are aggregated first, so only segments times regions of one file meet.
    """
    def centre(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(atoms, ["file", "residue"]).groupBy("file", key).agg(*[F.avg(c).alias(c) for c in "xyz"])

    a, b = centre(segments, "segment"), centre(region_residues, "module_id")
    gap = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0.0)))
    d = a.alias("a").join(b.alias("b"), "file").select("file", "segment", "module_id", gap.alias("distance"))
    w = Window.partitionBy("file", "segment").orderBy("distance", "module_id")
    ranked = d.withColumn("k", F.dense_rank().over(Window.partitionBy("file", "segment").orderBy("distance"))).withColumn("n", F.row_number().over(w))
    second = ranked.groupBy("file", "segment").agg(F.min(F.when(F.col("k") == 2, F.col("distance"))).alias("second"))
    best = ranked.where("n = 1").join(second, ["file", "segment"])
    good = (F.col("distance") < near) & (F.col("second").isNull() | (F.col("distance") < clearly * F.col("second")))
    return best.where(good).select("file", "segment", "module_id", "distance")


def completed(regions: DataFrame, assigned: DataFrame, segments: DataFrame) -> DataFrame:
    """Regions with the residues of the segments assigned to them, mapped to -1."""
    extra = assigned.join(segments, ["file", "segment"]).groupBy("file", "module_id").agg(F.array_sort(F.collect_set("residue")).alias("_r"))
    more = F.map_from_arrays(F.array_except("_r", F.map_keys("residues")), F.transform(F.array_except("_r", F.map_keys("residues")), lambda _: F.lit(-1)))
    out = regions.join(extra, ["file", "module_id"], "left")
    return out.withColumn("residues", F.when(F.col("_r").isNull(), F.col("residues")).otherwise(F.map_concat("residues", more))).select(*regions.columns)


def unassigned_segments(all_residues: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, segment, residue): continuous runs of remaining residues."""
    runs = islands(remaining(all_residues, regions), ["file"], "residue")
    return runs.select("file", F.col("island").alias("segment"), F.explode(F.sequence("lo", "hi")).alias("residue"))


def shifted_mapping(pairs: list[tuple[int, int]], members: Sequence[int], target: Sequence[int]) -> dict[int, int]:
    """Maps ``members`` of one domain to residues of a target.

    A member with its own shift moves by it; another by the mean of the two nearest
    shifts, halves to even.  The first member that comes to a target residue has
    it; residues outside of the target are left out.
    """
    shift = {a: b - a for a, b in pairs}
    known = np.array(sorted(shift))
    there, out, used = set(target), {}, set()
    for m in members:
        if m in shift:
            to = m + shift[m]
        elif len(known):
            near = known[np.argsort(np.abs(known - m), kind="stable")[:2]]
            to = m + round(sum(shift[int(x)] for x in near) / len(near))
        else:
            continue
        if to in there and to not in used:
            out[m] = to
            used.add(to)
    return out
