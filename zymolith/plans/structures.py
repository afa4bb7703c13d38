"""Segment, tree, fold, region and alignment queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import TEMPLATES
from ..functions.scratch import written
from ..functions.sides import small_side
from ..operators import alignment as A
from ..operators import folds as K
from ..operators import segments as S
from ..operators import structure as G
from ..operators import trees as T
from ..operators.clustering import subtype_table
from .registry import query, r6, rounded, table

#: Residue sets: the hours on which a user has events of a type.
_HOURS = "h AS (SELECT DISTINCT user_id AS file, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) // 8 AS v FROM events)"
_ISLANDS = """isl AS (SELECT file, min(v) AS lo, max(v) AS hi, count(*) AS n FROM (SELECT file, v, sum(brk) OVER (PARTITION BY file ORDER BY v) AS g FROM (
  SELECT file, v, CASE WHEN v - lag(v) OVER (PARTITION BY file ORDER BY v) <= {gap} THEN 0 ELSE 1 END AS brk FROM h)) GROUP BY file, g)"""


def hours(spark, d):
    e = table(spark, d, "events")
    h = F.floor(F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), "ts") / 8).cast("int")
    return e.select(F.col("user_id").alias("file"), h.alias("value")).distinct()


@query("w2_compressed", f"WITH {_HOURS}, {_ISLANDS.format(gap=1)} SELECT file, string_agg(CASE WHEN lo = hi THEN lo || '' ELSE lo || '-' || hi END, '+' ORDER BY lo) AS selection FROM isl GROUP BY file")
def w2(spark, d):
    return S.compressed(hours(spark, d), ["file"])


@query("w3_long_segments", f"WITH {_HOURS}, {_ISLANDS.format(gap=2)} SELECT file, lo, hi FROM isl WHERE hi - lo >= 4")
def w3(spark, d):
    return S.long_segments(hours(spark, d), ["file"], 4, gap=2).select("file", "lo", "hi")


@query(
    "w4_longest_segment",
    f"""WITH {_HOURS}, b AS (SELECT file, v FROM h WHERE v % 7 = 0), r AS (SELECT file, v FROM h WHERE v % 7 <> 0),
    i AS (SELECT r.file, r.v, (SELECT count(*) FROM b WHERE b.file = r.file AND b.v < r.v) AS g FROM r),
    c AS (SELECT file, g, count(*) AS m FROM i GROUP BY file, g), k AS (SELECT file, g, row_number() OVER (PARTITION BY file ORDER BY m DESC, g) AS n FROM c),
    s AS (SELECT i.file, i.v, lag(i.v) OVER (PARTITION BY i.file ORDER BY i.v) AS p FROM i JOIN k ON k.file = i.file AND k.g = i.g AND k.n = 1)
    SELECT file, CAST(x AS INTEGER) AS value FROM (SELECT file, unnest(CASE WHEN p + 5 >= v THEN range(p + 1, v + 1) ELSE [v]::BIGINT[] END) AS x FROM s)""",
)
def w4(spark, d):
    h = hours(spark, d)
    return S.longest_segment(h.where("value % 7 <> 0"), h.where("value % 7 = 0"), ["file"])


@query("w5_gap_filled", f"WITH {_HOURS}, s AS (SELECT file, v, lag(v) OVER (PARTITION BY file ORDER BY v) AS p FROM h) SELECT file, CAST(x AS INTEGER) AS value FROM (SELECT file, unnest(CASE WHEN p + 5 >= v THEN range(p + 1, v + 1) ELSE [v]::BIGINT[] END) AS x FROM s)")
def w5(spark, d):
    return S.gap_filled(hours(spark, d), ["file"])


@query(
    "w6_halved_segments",
    f"""WITH RECURSIVE {_HOURS}, {_ISLANDS.format(gap=9)}, cut AS (SELECT file, lo::BIGINT AS lo, hi::BIGINT AS hi FROM isl UNION ALL
      SELECT file, unnest([lo, (lo + hi) // 2 + 1]), unnest([(lo + hi) // 2, hi]) FROM cut WHERE hi - lo > 7)
    SELECT file, lo, hi FROM cut WHERE hi - lo <= 7""",
)
def w6(spark, d):
    return S.halved_segments(S.islands(hours(spark, d), ["file"], gap=9).select("file", "lo", "hi"), 7)


@query(
    "w9_alignment_positions",
    """WITH c AS (SELECT item_id, unnest(generate_series(1, length(text))) AS p, text FROM benchmark),
    o AS (SELECT item_id, p - 1 AS original_pos, row_number() OVER (PARTITION BY item_id ORDER BY p) AS n FROM c WHERE substr(text, p, 1) <> ' '),
    a AS (SELECT item_id, p - 1 AS aligned_pos, row_number() OVER (PARTITION BY item_id ORDER BY p) AS n FROM c WHERE substr(text, p, 1) <> ' ')
    SELECT item_id, original_pos::INTEGER AS original_pos, aligned_pos::INTEGER AS aligned_pos FROM o JOIN a USING (item_id, n)""",
)
def w9(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.translate("text", "\n", "n").alias("o"))
    return S.alignment_positions(b.withColumn("a", F.translate("o", " ", "-")), "item_id", "o", "a")


@query(
    "w7_two_nearest_mean",
    f"""WITH {_HOURS}, k AS (SELECT file, v, (v * 7 % 13)::DOUBLE AS s FROM h WHERE v % 3 = 0), q AS (SELECT file, v FROM h WHERE v % 3 = 1),
    r AS (SELECT q.file, q.v, s, row_number() OVER (PARTITION BY q.file, q.v ORDER BY abs(k.v - q.v), k.v) AS n FROM q JOIN k USING (file))
    SELECT file, v AS at, round_even(avg(s), 0) AS value FROM r WHERE n <= 2 GROUP BY ALL UNION ALL SELECT file, v, NULL FROM q WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = q.file)""",
)
def w7(spark, d):
    h = hours(spark, d).withColumnRenamed("value", "at")
    known = h.where("at % 3 = 0").withColumn("value", (F.col("at") * 7 % 13).cast("double"))
    return S.two_nearest_mean(known, h.where("at % 3 = 1"), ["file"])


_TREE = """edges AS (SELECT 'root' AS node, NULL AS parent, 0.0::DOUBLE AS length UNION ALL SELECT 'r' || r_regionkey, 'root', 0.1 * r_regionkey FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.05 * (n_nationkey % 7) FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, (c_custkey % 11) / 20.0::DOUBLE FROM customer)"""
_DEPTHS = """d0 AS (SELECT node, parent, length AS depth FROM edges WHERE node LIKE 'c%'),
d1 AS (SELECT e.node, e.parent, e.length + coalesce(max(d0.depth), 0) AS depth FROM edges e LEFT JOIN d0 ON d0.parent = e.node WHERE e.node LIKE 'n%' GROUP BY e.node, e.parent, e.length),
d2 AS (SELECT e.node, e.parent, e.length + coalesce(max(d1.depth), 0) AS depth FROM edges e LEFT JOIN d1 ON d1.parent = e.node WHERE e.node LIKE 'r%' AND e.node <> 'root' GROUP BY e.node, e.parent, e.length),
d3 AS (SELECT 'root' AS node, NULL AS parent, max(depth) AS depth FROM d2),
depths AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""


def tree(spark, d):
    r, n, c = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    root = r.limit(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length"))
    rows = root.unionByName(r.select(name("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), (0.1 * F.col("r_regionkey")).alias("length")))
    rows = rows.unionByName(n.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), (0.05 * (F.col("n_nationkey") % 7)).alias("length")))
    return rows.unionByName(c.select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"), ((F.col("c_custkey") % 11) / 20.0).alias("length")))


@query("a20_tree_max_depth", f"WITH {_TREE}, {_DEPTHS} SELECT node, round(depth, 6) AS depth FROM depths")
def a20(spark, d):
    return rounded(T.max_depths(tree(spark, d)).select("node", "depth"), "depth")


@query(
    "a21_clade_clusters",
    f"""WITH {_TREE}, {_DEPTHS}, o AS (SELECT node, round(depth, 6) < 0.72 AS op FROM depths),
    l AS (SELECT c.node AS leaf, n.node AS n, r.node AS r FROM edges c JOIN edges n ON n.node = c.parent JOIN edges r ON r.node = n.parent WHERE c.node LIKE 'c%')
    SELECT leaf, CASE WHEN NOT a.op THEN leaf WHEN NOT b.op THEN l.n WHEN NOT z.op THEN l.r ELSE 'root' END AS root
    FROM l JOIN o a ON a.node = l.n JOIN o b ON b.node = l.r JOIN o z ON z.node = 'root'
    UNION ALL SELECT node, node FROM edges e WHERE e.node LIKE 'n%' AND NOT EXISTS (SELECT 1 FROM edges c WHERE c.parent = e.node)""",
)
def a21(spark, d):
    return T.clade_clusters(tree(spark, d), 0.72)


@query("l10_group_kfold")
def l10(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("group"), F.col("c_mktsegment").alias("label"), "c_custkey")
    return c.join(K.group_kfold(K.group_counts(c), 5, 50), "group").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l10_stratified_kfold", "SELECT toxic, count(*) AS n, true AS even FROM labels GROUP BY toxic")
def l10s(spark, d):
    out = K.stratified_kfold(table(spark, d, "labels"), 5, "doc_id", F.col("toxic"))
    by = out.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("toxic").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 1).alias("even"))


@query(
    "l11_group_ids",
    """SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 AND c_custkey % 3 = 0 THEN 'clade-' || c_nationkey ELSE 'id-' || c_custkey END AS grp FROM customer""",
)
def l11(spark, d):
    c = table(spark, d, "customer")
    clades = c.where("c_nationkey < 12").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("clade"))
    majors = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    return K.group_ids(c.select(F.col("c_custkey").alias("id")), clades, majors).select("id", F.col("group").alias("grp"))


_ITEMS = "items AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS k, l_partkey % 300 AS residue FROM lineitem)"
_DOMAINS = ("alpha", "beta", "gamma", "delta", "epsilon")
_NAME = "CASE k % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'delta' ELSE 'epsilon' END"
_REGIONS = f"regions AS (SELECT file, k, {_NAME} AS domain, ((file * 7 + k * 13) % 100) / 100.0::DOUBLE AS score, count(*) AS n FROM items GROUP BY ALL)"


def regions(spark, d):
    """Candidate regions: a supplier's parts by line number, with a score from both numbers."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 300).cast("int").alias("residue")).distinct()
    domain = F.element_at(F.array(*[F.lit(x) for x in _DOMAINS]), (F.col("k") % 5 + 1).cast("int"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("residue", F.col("residue").alias("to")))))
    out = li.groupBy("file", "k").agg(entries.alias("residues"))
    score = ((F.col("file") * 7 + F.col("k") * 13) % 100) / 100.0
    out = out.select("file", F.concat_ws("_", "file", "k").alias("module_id"), domain.alias("domain"), score.alias("score"), "residues")
    return written(out, "regions")  # several steps of a query read it


_LIMITS = "limits(domain, s, z) AS (VALUES ('alpha', 0.35, 130), ('beta', 0.60, 50), ('gamma', 0.55, 50), ('delta', 0.60, 50), ('epsilon', 0.60, 50))"


@query("g1_alignments_kept", f"WITH {_ITEMS}, {_REGIONS}, {_LIMITS} SELECT file || '_' || k AS module_id, domain FROM regions JOIN limits USING (domain) WHERE score >= s AND n >= z")
def g1(spark, d):
    return G.alignments_kept(regions(spark, d), G.thresholds(spark)).select("module_id", "domain")


@query("g2_mapped_regions", f"WITH {_ITEMS}, {_REGIONS}, {_LIMITS} SELECT file || '_' || k AS module_id, domain FROM regions JOIN limits USING (domain) WHERE score > s AND n >= z")
def g2(spark, d):
    return G.mapped_regions(regions(spark, d), G.thresholds(spark)).select("module_id", "domain")


@query("g3_thresholds", f"WITH {_ITEMS}, {_REGIONS}, {_LIMITS} SELECT domain, s::DOUBLE AS least_score, z AS least_size, count(*) FILTER (score >= s) AS by_score, count(*) FILTER (score >= s AND n >= z) AS kept FROM limits LEFT JOIN regions USING (domain) GROUP BY ALL")
def g3(spark, d):
    """Each domain's thresholds, and how many candidate regions reach the first and both of them."""
    r = regions(spark, d).select("domain", "score", G.size().alias("n"))
    reach = F.col("score") >= F.col("least_score")
    both = G.thresholds(spark).join(r, "domain", "left")
    return both.groupBy("domain", "least_score", "least_size").agg(F.count(F.when(reach, 1)).alias("by_score"), F.count(F.when(reach & (F.col("n") >= F.col("least_size")), 1)).alias("kept"))


@query("g4_remaining", f"WITH {_ITEMS}, {_REGIONS} SELECT DISTINCT file, residue::INTEGER AS residue FROM items i WHERE NOT EXISTS (SELECT 1 FROM items j WHERE j.file = i.file AND j.residue = i.residue AND j.k % 5 = 0)")
def g4(spark, d):
    r = regions(spark, d)
    every = G.residues_of(r).select("file", "residue").distinct()
    return G.remaining(every, r.where("domain = 'alpha'"))


def _detected() -> str:
    order = "CASE domain WHEN 'alpha' THEN 1 WHEN 'epsilon' THEN 2 WHEN 'delta' THEN 3 WHEN 'beta' THEN 4 ELSE 5 END"
    steps = [f"good AS (SELECT file, k, domain, n, {order} AS g FROM regions JOIN limits USING (domain) WHERE score >= s)"]
    steps.append("ov AS (SELECT a.file, a.k, b.k AS kb FROM items a JOIN good x ON x.file = a.file AND x.k = a.k JOIN items b ON b.file = a.file AND b.residue = a.residue JOIN good y ON y.file = b.file AND y.k = b.k AND y.g < x.g GROUP BY a.file, a.k, b.k HAVING count(*) / max(x.n) >= 0.5)")
    steps.append("k1 AS (SELECT * FROM good WHERE g = 1)")
    for g in range(2, 6):
        steps.append(f"k{g} AS (SELECT * FROM k{g - 1} UNION ALL SELECT * FROM good x WHERE g = {g} AND NOT EXISTS (SELECT 1 FROM ov JOIN k{g - 1} z ON z.file = ov.file AND z.k = ov.kb WHERE ov.file = x.file AND ov.k = x.k))")
    return ", ".join(steps)


@query("g5_detect_domains", f"WITH {_ITEMS}, {_REGIONS}, {_LIMITS}, {_detected()} SELECT file, file || '_' || k AS module_id, domain, n::INTEGER AS n FROM k5")
def g5(spark, d):
    return G.detect_domains(regions(spark, d), G.thresholds(spark)).select("file", "module_id", "domain", G.size().alias("n"))


@query(
    "g7_could_hold_another",
    f"""WITH {_ITEMS}, every AS (SELECT DISTINCT file, residue FROM items), l AS (SELECT e.file, e.residue FROM every e WHERE NOT EXISTS (SELECT 1 FROM items j WHERE j.file = e.file AND j.residue = e.residue AND j.k = 5)),
    b AS (SELECT file, residue, sum(brk) OVER (PARTITION BY file ORDER BY residue) AS g FROM (SELECT file, residue, CASE WHEN residue - lag(residue) OVER (PARTITION BY file ORDER BY residue) <= 5 THEN 0 ELSE 1 END AS brk FROM l))
    SELECT file FROM l WHERE file NOT IN (SELECT file FROM items WHERE k = 5) GROUP BY file HAVING count(*) > 50 UNION SELECT file FROM b GROUP BY file, g HAVING max(residue) - min(residue) >= 50""",
)
def g7(spark, d):
    r = regions(spark, d)
    every = G.residues_of(r).select("file", "residue").distinct()
    return G.could_hold_another(every, r.where(F.col("module_id").endswith("_5")))


@query("g9_confident_only", f"WITH {_ITEMS} SELECT file || '_' || k AS module_id, count(*)::INTEGER AS n FROM items WHERE residue % 4 <> 0 GROUP BY ALL")
def g9(spark, d):
    r = regions(spark, d)
    good = G.residues_of(r).where("residue % 4 <> 0").select("file", "residue").distinct()
    return G.confident_only(r, good).select("module_id", G.size().alias("n"))


@query("g10_partitioned_regions", f"WITH {_ITEMS}, {_REGIONS} SELECT domain, count(*) AS n FROM regions GROUP BY domain UNION ALL SELECT 'all', count(*) FROM regions")
def g10(spark, d):
    r = regions(spark, d)
    return r.unionByName(r.withColumn("domain", F.lit("all"))).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("g13_regions_of_domains", f"WITH {_ITEMS}, {_REGIONS} SELECT file || '_' || k AS module_id, n::INTEGER AS n FROM regions WHERE domain IN ('alpha', 'delta')")
def g13(spark, d):
    return regions(spark, d).where(F.col("domain").isin("alpha", "delta")).select("module_id", G.size().alias("n"))


@query(
    "g13_longest_unmapped",
    f"""WITH {_ITEMS}, b AS (SELECT DISTINCT file, residue AS v FROM items WHERE k % 5 IN (0, 3)), r AS (SELECT DISTINCT file, residue AS v FROM items EXCEPT SELECT * FROM b),
    i AS (SELECT r.file, r.v, (SELECT count(*) FROM b WHERE b.file = r.file AND b.v < r.v) AS g FROM r),
    c AS (SELECT file, g, count(*) AS m FROM i GROUP BY file, g), q AS (SELECT file, g, row_number() OVER (PARTITION BY file ORDER BY m DESC, g) AS n FROM c),
    s AS (SELECT i.file, i.v, lag(i.v) OVER (PARTITION BY i.file ORDER BY i.v) AS p FROM i JOIN q ON q.file = i.file AND q.g = i.g AND q.n = 1)
    SELECT file, x::INTEGER AS residue FROM (SELECT file, unnest(CASE WHEN p + 5 >= v THEN range(p + 1, v + 1) ELSE [v]::BIGINT[] END) AS x FROM s)""",
)
def g13b(spark, d):
    r = regions(spark, d)
    every = G.residues_of(r).select("file", "residue").distinct()
    return G.longest_unmapped(every, r, ["alpha", "delta"])


@query("j15_nearest_region")
def j15(spark, d):
    """Atoms: residues of a file on a spiral; segments: what no alpha region has."""
    r = regions(spark, d)
    every = G.residues_of(r).select("file", "residue").distinct()
    atoms = every.select("file", "residue", (F.cos(F.col("residue") / 9.0) * 20).alias("x"), (F.sin(F.col("residue") / 9.0) * 20).alias("y"), (F.col("residue") * 0.4).alias("z"))
    alpha = r.where("domain = 'alpha'")
    left = G.unassigned_segments(every, alpha)
    found = G.nearest_regions(atoms, left, G.residues_of(alpha).select("file", "module_id", "residue"))
    return found.withColumn("distance", r6("distance"))


def _trace(spark, d):
    """(id, label, points): each vector as the trace of a chain, steps of three components from residue to residue."""
    v = table(spark, d, "embeddings")
    step = lambda k: F.transform(F.slice("embedding", k * 3 + 1, F.lit(3)), lambda x: x.cast("double") * 10)
    walk = F.aggregate(
        F.sequence(F.lit(0), F.lit(20)),
        F.array().cast("array<array<double>>"),
        lambda seen, k: F.concat(seen, F.array(F.when(F.size(seen) == 0, step(k)).otherwise(F.zip_with(F.try_element_at(seen, F.lit(-1)), step(k), lambda a, b: a + b)))),
    )
    return v.select(F.col("vec_id").alias("id"), "label", walk.alias("points"))


@query("f11_pair_scores")
def f11(spark, d):
    """Pairs of one label, as regions of one domain type are compared."""
    return rounded(A.pair_scores(_trace(spark, d), within="label"), "score")


@query("g11_cached_scores")
def g11(spark, d):
    """Pairs of one label of which a part is known, as in an interrupted run; the known ones carry a mark instead of a score."""
    t = _trace(spark, d)
    ids = t.select("id", "label")
    other = ids.select(F.col("id").alias("j"), (F.col("id") - 1).alias("next"), F.col("label").alias("other"))
    cache = ids.join(other, (F.col("id") == F.col("next")) & (F.col("label") == F.col("other"))).select(F.col("j").alias("i"), F.col("id").alias("j"), F.lit(-1.0).alias("score"))
    return rounded(A.cached_scores(t, cache, "label"), "score")


def _templates_of(spark, d):
    """(domain, residue, x, y, z): the first chain of each of five labels stands for a domain."""
    t = _trace(spark, d).where("label < 5")
    first = t.groupBy("label").agg(F.min_by("points", "id").alias("points"))
    name = F.element_at(F.array(*[F.lit(x) for x in _DOMAINS]), F.col("label") + 1)
    rows = first.select(name.alias("domain"), F.posexplode("points").alias("residue", "p"))
    return rows.select("domain", "residue", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")])


def _atoms_of(spark, d):
    rows = _trace(spark, d).select(F.col("id").alias("file"), F.posexplode("points").alias("residue", "p"))
    return rows.select("file", "residue", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")])


@query("g1_template_alignments")
def g1_aligned(spark, d):
    """Every chain against every template."""
    chains = _atoms_of(spark, d).withColumn("domain", F.explode(F.array(*[F.lit(x) for x in _DOMAINS])))
    out = A.template_alignments(chains, _templates_of(spark, d))
    return out.select("file", "domain", r6("score").alias("score"), F.size("pairs").alias("n"))


@query("g4_all_encounters")
def g4_all(spark, d):
    """All instances of each domain in each chain: passes over what earlier instances have left."""
    limits = _templates_of(spark, d).groupBy("domain").agg(F.lit(0.3).alias("least_score"), (F.count(F.lit(1)) / 4).cast("int").alias("least_size"))
    return A.encounters(_atoms_of(spark, d), _templates_of(spark, d), limits).select("file", "domain", "pass", r6("score").alias("score"), G.size().alias("n"))


@query(
    "w7_full_mapping",
    f"""WITH {_HOURS}, p AS (SELECT file, v AS member, (v * 7 % 13)::DOUBLE - 6 AS shift FROM h WHERE v % 3 = 0),
    r AS (SELECT q.file, q.v AS member, shift, row_number() OVER (PARTITION BY q.file, q.v ORDER BY abs(p.member - q.v), p.member) AS n FROM h q JOIN p USING (file) WHERE q.v % 3 <> 0),
    s AS (SELECT file, member, shift FROM p UNION ALL SELECT file, member, round_even(avg(shift), 0) FROM r WHERE n <= 2 GROUP BY file, member),
    m AS (SELECT file, member, (member + shift)::INTEGER AS residue FROM s)
    SELECT m.file, residue, min(member)::INTEGER AS member FROM m WHERE EXISTS (SELECT 1 FROM h WHERE h.file = m.file AND h.v = m.residue) GROUP BY m.file, residue""",
)
def w7_full(spark, d):
    """Known shifts at every third place; all places of a user are both the members and the residues there are."""
    h = hours(spark, d)
    pairs = h.where("value % 3 = 0").select("file", F.col("value").alias("member"), (F.col("value") + F.col("value") * 7 % 13 - 6).alias("to"))
    return A.full_mapping(pairs, h.select("file", F.col("value").alias("member")), h.select("file", F.col("value").alias("residue")), ["file"])


@query(
    "l16_subtype_table",
    """WITH s AS (SELECT p_type AS type, p_brand AS subtype, sum(CASE WHEN p_size > 20 THEN 1 ELSE 0 END)::BIGINT AS inside, sum(CASE WHEN p_size > 20 THEN 0 ELSE 1 END)::BIGINT AS outside FROM part GROUP BY ALL)
    SELECT *, ['A', 'B', 'C', 'D', 'E', 'F'][row_number() OVER (PARTITION BY type ORDER BY inside DESC, subtype)] AS letter FROM s WHERE inside > 2""",
)
def l16(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("subtype"), "p_size")
    return subtype_table(p, F.col("p_size") > 20)


_SELECTIONS = ", ".join(f"('{d}', {'NULL' if r is None else repr(r)})" for d, (_, r) in TEMPLATES.items())


@query(
    "g14_templates",
    f"""WITH {_ITEMS}, t(domain, sel) AS (VALUES {_SELECTIONS}), p AS (SELECT domain, unnest(string_split(sel, '+')) AS x FROM t),
    r AS (SELECT domain, unnest(range(split_part(x, '-', 1)::INTEGER, split_part(x, '-', 2)::INTEGER + 1)) AS residue FROM p), every AS (SELECT DISTINCT file, residue FROM items)
    SELECT t.domain, e.file, count(*) AS residues FROM t JOIN every e ON t.sel IS NULL OR EXISTS (SELECT 1 FROM r WHERE r.domain = t.domain AND r.residue = e.residue) GROUP BY ALL""",
)
def g14(spark, d):
    """How many of a file's residues lie in each template's selection; a template without one takes all."""
    every = G.residues_of(regions(spark, d)).select("file", "residue").distinct()
    t = G.templates(spark).select("domain", F.col("residue").alias("r"))
    met = every.join(small_side(t), F.col("r").isNull() | (F.col("r") == F.col("residue")))
    return met.groupBy("domain", "file").agg(F.count(F.lit(1)).alias("residues"))
