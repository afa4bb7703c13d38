"""Queries over structure files, trees, run registries and the steps around domain detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import structure as G
from ..sources import configs as C
from ..sources import structures as A
from ..sources import text_formats as X
from ..streaming.screening import scored
from .registry import query, table
from .structures import _ITEMS, _REGIONS, regions
from .workflows import test_rows as rows_to_score


@query("s7_fasta_loose", "SELECT 'junkc' || c_custkey AS header, replace(c_name || c_mktsegment, ' ', '') AS sequence FROM customer")
def s7(spark, d):
    to = scratch_path(spark, "loose")
    value = F.concat(F.lit("junk>c"), "c_custkey", F.lit("\n"), "c_name", F.lit("\n "), "c_mktsegment", F.lit(" "))
    table(spark, d, "customer").select(value.alias("value")).write.text(to)
    return X.read_fasta_loose(spark, to).select("header", "sequence")


@query(
    "s11_secondary_residues",
    """SELECT DISTINCT unnest(range(lo, hi + 1))::INTEGER AS residue FROM (SELECT s_suppkey * 13 % 900 AS lo, s_suppkey * 13 % 900 + s_nationkey % 5 AS hi FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL SELECT s_suppkey * 7 % 900, s_suppkey * 7 % 900 + s_nationkey % 3 FROM supplier WHERE s_suppkey % 2 = 1)""",
)
def s11(spark, d):
    s, to = table(spark, d, "supplier"), scratch_path(spark, "pdb")
    line = lambda form, by, most: F.format_string(form, F.lit(""), (F.col("s_suppkey") * by % 900).cast("int"), F.lit(""), (F.col("s_suppkey") * by % 900 + F.col("s_nationkey") % most).cast("int"))
    value = F.when(F.col("s_suppkey") % 2 == 0, line("HELIX%16s%4d%8s%4d", 13, 5)).otherwise(line("SHEET%17s%4d%7s%4d", 7, 3))
    s.select(value.alias("value")).write.text(to)
    return A.secondary_residues(spark, to).select("residue").distinct()


def _atoms(spark, d):
    p = table(spark, d, "part")
    return p.select(
        (F.col("p_partkey") % 4).alias("module_id"),
        F.col("p_partkey").cast("int").alias("serial"),
        F.when(F.col("p_partkey") % 2 == 0, "CA").otherwise("N").alias("atom"),
        F.lit("ALA").alias("residue_name"),
        F.lit("A").alias("chain"),
        F.floor(F.col("p_partkey") / 2 % 9000).cast("int").alias("residue"),
        F.lit("").alias("insertion"),
        *[(F.col("p_partkey") * k % 100).cast("double").alias(c) for k, c in ((1, "x"), (3, "y"), (7, "z"))],
        (F.col("p_size") * 2).cast("double").alias("confidence"),
    )


@query(
    "k8_atoms_round_trip",
    """SELECT p_partkey::INTEGER AS serial, CASE WHEN p_partkey % 2 = 0 THEN 'CA' ELSE 'N' END AS atom, (p_partkey // 2 % 9000)::INTEGER AS residue,
      (p_partkey % 100)::DOUBLE AS x, (p_partkey * 3 % 100)::DOUBLE AS y, (p_partkey * 7 % 100)::DOUBLE AS z, (p_size * 2)::DOUBLE AS confidence FROM part""",
)
def k8(spark, d):
    to = scratch_path(spark, "atoms")
    A.write_atoms(_atoms(spark, d), to)
    return A.read_atoms(spark, to).select("serial", "atom", "residue", "x", "y", "z", "confidence")


@query("s12_confident_residues", "SELECT residue FROM (SELECT (p_partkey // 2 % 9000)::INTEGER AS residue, arg_min(p_size * 2, p_partkey) AS c FROM part GROUP BY residue) WHERE c >= 70")
def s12(spark, d):
    """All atoms as one structure."""
    return A.confident_residues(_atoms(spark, d).withColumn("file", F.lit("s")), 70.0).select("residue")


@query(
    "s17_newick",
    """SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, n_nationkey / 4.0::DOUBLE AS length FROM nation
    UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey / 8.0::DOUBLE FROM region UNION ALL SELECT 'root', NULL, NULL""",
)
def s17(spark, d):
    to = scratch_path(spark, "tree")
    named = lambda p, k, by: F.concat(F.lit(p), F.col(k), F.lit(":"), F.col(k) / F.lit(by))
    leaves = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(named("n", "n_nationkey", 4.0))), ",").alias("inner"))
    inner = table(spark, d, "region").join(leaves, F.col("r_regionkey") == F.col("n_regionkey"))
    inner = inner.select(F.concat(F.lit("("), "inner", F.lit(")"), named("r", "r_regionkey", 8.0)).alias("x"))
    inner.agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("x")), ","), F.lit(")root;")).alias("value")).coalesce(1).write.text(to)
    return X.read_newick(spark, to)


_RUNS = """reg AS (SELECT CASE event_id % 4 WHEN 3 THEN 'all_folds' ELSE 'f' || event_id % 4 END AS fold, CASE event_id % 5 WHEN 4 THEN 'all_classes' ELSE event_type END AS class, event_id AS ts, 'run-' || event_id AS path FROM events),
  runs AS (SELECT fold AS rf, class AS rc, arg_max(path, ts) AS path FROM reg WHERE NOT (fold = 'f1' AND class IN ('click', 'all_classes')) AND NOT (fold = 'f2' AND class = 'view') GROUP BY ALL),
  wanted AS (SELECT DISTINCT fold, event_type AS class FROM events, (VALUES ('f0'), ('f1'), ('f2')) f(fold))"""


@query("s20_latest_results", f"WITH {_RUNS} SELECT fold, class, arg_max(path, CASE WHEN rf = fold THEN 2 ELSE 0 END + CASE WHEN rc = class THEN 1 ELSE 0 END) AS path FROM wanted JOIN runs ON (rf = fold OR rf = 'all_folds') AND (rc = class OR rc = 'all_classes') GROUP BY fold, class")
def s20(spark, d):
    e, fold, kind = table(spark, d, "events"), F.col("event_id") % 4, F.col("event_id") % 5
    reg = e.select(
        F.when(fold == 3, "all_folds").otherwise(F.concat(F.lit("f"), fold)).alias("fold"),
        F.when(kind == 4, "all_classes").otherwise(F.col("event_type")).alias("class"),
        F.col("event_id").alias("ts"),
        F.concat(F.lit("run-"), "event_id").alias("path"),
    )
    reg = reg.where(~((F.col("fold") == "f1") & F.col("class").isin("click", "all_classes")) & ~((F.col("fold") == "f2") & (F.col("class") == "view")))
    wanted = e.select("event_type").distinct().select(F.explode(F.array(*[F.lit(f"f{k}") for k in range(3)])).alias("fold"), F.col("event_type").alias("class"))
    return C.latest_results(reg, wanted)


_NAMED = "CASE p_partkey % 4 WHEN 0 THEN 'P(' || p_partkey || ')' WHEN 1 THEN 'Q-' || p_partkey WHEN 2 THEN 'R' || p_partkey ELSE 'alpha_object' END"


@query(
    "s22_needed_files",
    f"""SELECT DISTINCT file, regexp_replace(file, '[()-]', '', 'g') AS clean FROM (SELECT {_NAMED} AS file, p_size FROM part)
    WHERE p_size > 10 AND file <> 'alpha_object' AND regexp_replace(file, '[()-]', '', 'g') IN (SELECT ['P', 'Q', 'R', 'S'][p_partkey % 4 + 1] || p_partkey FROM part WHERE p_partkey % 3 = 0)""",
)
def s22(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.expr(_NAMED).alias("file"))
    ids = p.where("p_partkey % 3 = 0").select(F.concat(F.element_at(F.array(*map(F.lit, "PQRS")), (F.col("p_partkey") % 4 + 1).cast("int")), "p_partkey").alias("id"))
    return A.needed_files(p.select("file").distinct(), ids, p.where("p_size > 10").select("file"))


@query("p28_test_rows", "SELECT 'fold' AS split, o_orderkey FROM orders WHERE o_orderkey % 5 = 2 UNION ALL SELECT 'holdout', o_orderkey FROM orders WHERE o_orderkey % 7 = 1 OR o_orderkey % 11 = 3 AND o_orderkey % 7 <> 1")
def p28(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("fold"))
    holdout, negatives = o.where("o_orderkey % 7 = 1").drop("fold"), o.where("o_orderkey % 11 = 3 and o_orderkey % 7 <> 1").drop("fold")
    mine = rows_to_score(o, 2).select(F.lit("fold").alias("split"), "o_orderkey")
    return mine.unionByName(rows_to_score(o, 2, holdout, negatives).select(F.lit("holdout").alias("split"), "o_orderkey"))


@query(
    "g6_completed",
    f"""WITH {_ITEMS}, {_REGIONS}, a AS (SELECT file, k, n, row_number() OVER (PARTITION BY file ORDER BY file || '_' || k) AS r FROM regions WHERE domain = 'alpha'),
    rest AS (SELECT file, count(DISTINCT residue) AS m FROM items i WHERE NOT EXISTS (SELECT 1 FROM items j WHERE j.file = i.file AND j.residue = i.residue AND j.k % 5 = 0) GROUP BY file)
    SELECT file || '_' || k AS module_id, (n + CASE WHEN r = 1 THEN coalesce(m, 0) ELSE 0 END)::INTEGER AS n FROM a LEFT JOIN rest USING (file)""",
)
def g6(spark, d):
    """Every unassigned segment of a file goes to its first alpha region."""
    r = regions(spark, d)
    alpha = r.where("domain = 'alpha'")
    every = G.residues_of(r).select("file", "residue").distinct()
    segments = G.unassigned_segments(every, alpha)
    first = alpha.groupBy("file").agg(F.min("module_id").alias("module_id"))
    assigned = segments.select("file", "segment").distinct().join(first, "file")
    return G.completed(alpha, assigned, segments).select("module_id", G.size().alias("n"))


@query("g8_third_pass", f"WITH {_ITEMS}, {_REGIONS} SELECT file || '_' || k AS module_id, domain FROM regions WHERE domain IN ('alpha', 'delta')")
def g8(spark, d):
    r = regions(spark, d)
    return G.with_third_pass(r.where("domain = 'alpha'"), r.where("domain in ('alpha', 'delta')")).select("module_id", "domain")


def _hungry():
    def model(texts: Sequence[str]) -> list[list[float]]:
        if any(ord(x[0]) % 5 == 0 for x in texts):
            raise MemoryError("too much")
        return [[float(ord(x[0]))] for x in texts]

    return model


@query("x5_out_of_memory", "SELECT item_id || '' AS id, CASE WHEN ord(text) % 5 = 0 THEN NULL ELSE ord(text)::DOUBLE END AS score, ord(text) % 5 = 0 AS failed FROM benchmark WHERE text <> ''")
def x5(spark, d):
    """A model without memory for some texts: their rows carry the error, all others their scores."""
    b = table(spark, d, "benchmark").where("text <> ''").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("sequence"))
    return scored(b, _hungry, ["c"]).select("id", "score", F.col("error").isNotNull().alias("failed"))
