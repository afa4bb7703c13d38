"""Cleaning, label-set and aggregation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chemistry import canonical
from ..functions.fixed_values import SUBSTRATES
from ..operators import cleaning as C
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import relations as R
from .registry import query, r6, rounded, table

SEGMENTS = {"BUILDING": "b", "MACHINERY": "m"}


@query("p1_dictionary_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS code FROM customer")
def p1(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.mapped(F.col("c_mktsegment"), SEGMENTS).alias("code"))


@query("p2_not_in_filter", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def p2(spark, d):
    out = table(spark, d, "nation").where("n_regionkey = 1")
    return C.not_in(table(spark, d, "supplier"), "s_nationkey", out, "n_nationkey").select("s_suppkey", "s_nationkey")


@query("p3_present_or_negative", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL OR o_orderpriority = '1-URGENT'")
def p3(spark, d):
    o = table(spark, d, "orders")
    return o.where(C.present_or(F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderpriority"), "1-URGENT")).select("o_orderkey")


@query(
    "p4_conditional_fixes",
    """SELECT p_partkey, CASE WHEN p_type = 'LARGE' AND p_name LIKE 'red%' THEN 'large red' WHEN p_size < 5 THEN 'tiny' WHEN p_type = 'PROMO' AND p_size > 40 THEN 'promo big' ELSE p_name END AS fixed FROM part""",
)
def p4(spark, d):
    t, n, s = F.col("p_type"), F.col("p_name"), F.col("p_size")
    rules = [((t == "PROMO") & (s > 40), "promo big"), (s < 5, "tiny"), ((t == "LARGE") & n.startswith("red"), "large red")]
    return table(spark, d, "part").select("p_partkey", C.conditional_fixes(n, rules).alias("fixed"))


@query("p5_precursor_rewrite", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'precursor substr' ELSE event_type END AS target FROM events")
def p5(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").select("event_id", L.precursor_rewrite(e, e, ("click", "view")).alias("target"))


@query("p6_ignored_rewrite", "SELECT event_id, CASE WHEN value > 90 THEN 'other' ELSE event_type END AS target FROM events")
def p6(spark, d):
    return table(spark, d, "events").select("event_id", L.ignored_rewrite(F.col("value") > 90, F.col("event_type")).alias("target"))


_SETS = "sets AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_returnflag))) AS labels FROM lineitem GROUP BY l_orderkey)"


def _sets(spark, d):
    return L.label_sets(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag").withColumnRenamed("l_orderkey", "id")


@query("p7_label_augment", f"WITH {_SETS} SELECT id, CASE WHEN list_contains(labels, 'N') THEN array_to_string(labels, ',') ELSE array_to_string(list_sort(list_append(labels, 'isTPS')), ',') END AS labels FROM sets")
def p7(spark, d):
    return _sets(spark, d).select("id", L.stratum(L.augmented(F.col("labels"), unless=("N", "Unknown"))).alias("labels"))


@query("p8_complete_rows", "SELECT c_custkey, (nullif(c_mktsegment, 'BUILDING') IS NOT NULL OR nullif(c_nationkey, 3) IS NOT NULL) AND c_acctbal > 0 AS complete FROM customer")
def p8(spark, d):
    fragment = F.when(F.col("c_acctbal") > 0, F.lit(None).cast("string")).otherwise(F.lit("Yes"))
    flag = C.complete(F.nullif("c_mktsegment", F.lit("BUILDING")), F.nullif("c_nationkey", F.lit(3)), fragment)
    return table(spark, d, "customer").select("c_custkey", flag.alias("complete"))


@query("p10_carbon_balance", "SELECT p_partkey, coalesce(length(regexp_replace(lower(p_name), '[^c]', '', 'g')) = length(regexp_replace(lower(nullif(p_type, 'LARGE')), '[^c]', '', 'g')), false) AS balanced FROM part")
def p10(spark, d):
    return table(spark, d, "part").select("p_partkey", C.carbon_balanced(F.col("p_name"), F.nullif("p_type", F.lit("LARGE"))).alias("balanced"))


@query("p11_can_be_canonical", "SELECT p_partkey, p_name NOT LIKE '%k%' AND p_name NOT LIKE '%t%' AS ok FROM part")
def p11(spark, d):
    return table(spark, d, "part").select("p_partkey", C.can_be_canonical(F.col("p_name")).alias("ok"))


@query("p12_category_normalise", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS category FROM customer")
def p12(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.mapped(F.col("c_mktsegment"), SEGMENTS, keep_unmatched=True).alias("category"))


@query("p13_two_column_semi_join", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m WHERE m.l_quantity > 49 AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey)")
def p13(spark, d):
    li = table(spark, d, "lineitem")
    return R.semi(li, li.where("l_quantity > 49"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("p14_trimmed_ids", "SELECT p_partkey, coalesce(trim(nullif('  ' || p_name || ' ', '  red widget ')), 'Negative') AS id FROM part WHERE p_brand <> 'Brand#4'")
def p14(spark, d):
    padded = F.nullif(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit("  red widget "))
    return table(spark, d, "part").where("p_brand <> 'Brand#4'").select("p_partkey", C.trimmed_id(padded).alias("id"))


@query("p15_standard_residues", "SELECT item_id, NOT regexp_matches(upper(text), '[UO]') AS standard, NOT regexp_matches(text, '[UO]') AS standard_as_is FROM benchmark")
def p15(spark, d):
    return table(spark, d, "benchmark").select("item_id", C.standard_residues(F.upper("text")).alias("standard"), C.standard_residues(F.col("text")).alias("standard_as_is"))


@query("p16_length_filter", "SELECT doc_id FROM documents WHERE length(text) <= 2000")
def p16(spark, d):
    return table(spark, d, "documents").where(C.short_enough(F.col("text"))).select("doc_id")


@query("p19_threshold_hits", "SELECT vec_id, embedding[1] >= 0.1 OR embedding[2] >= 0.1 AS hit FROM embeddings")
def p19(spark, d):
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, d, "embeddings").select("vec_id", C.detected(a, 0.1, b, True).alias("hit"))


@query("p21_row_tuples", "SELECT n_nationkey, n_name || '|' || n_regionkey AS pair FROM nation")
def p21(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws("|", "n_name", "n_regionkey").alias("pair"))


@query("p22_fill_null", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'Unknown') AS status, 1 AS one FROM orders")
def p22(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return o.na.fill(L.UNKNOWN, ["status"]).select("o_orderkey", "status", F.lit(1).alias("one"))


@query("p23_signature_presence", "SELECT p_partkey, CASE WHEN coalesce(nullif(p_brand, 'Brand#4'), nullif(p_type, 'LARGE')) IS NULL THEN 'Without' ELSE 'With' END AS signatures FROM part")
def p23(spark, d):
    return table(spark, d, "part").select("p_partkey", C.signature_presence(F.nullif("p_brand", F.lit("Brand#4")), F.nullif("p_type", F.lit("LARGE"))).alias("signatures"))


@query("p24_reaction_type", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'hot' WHEN o_orderstatus = 'F' THEN 'done' END AS type FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def p24(spark, d):
    rules = [("P", "1-URGENT", "hot"), ("F", "*", "done")]
    out = table(spark, d, "orders").select("o_orderkey", C.reaction_type(F.col("o_orderstatus"), F.col("o_orderpriority"), rules).alias("type"))
    return out.where(F.col("type").isNotNull())


@query(
    "p27_fold_column",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN 'fold_' || (o_orderkey % 7) ELSE '-1' END AS split, CASE WHEN o_orderpriority IN ('5-LOW') THEN '1' ELSE '' END AS split_ignore_in_eval FROM orders""",
)
def p27(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    folds = o.select("o_orderkey", (F.col("o_orderkey") % 7).alias("fold")).where("fold < 5")
    out = C.fold_column(o, folds, o.where("o_orderpriority = '5-LOW'").select("o_orderpriority").distinct(), "o_orderkey", "o_orderpriority")
    return out.drop("o_orderpriority")


@query(
    "p29_class_parameters",
    """SELECT 'p' || s_suppkey AS name, (CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 100 ELSE s_nationkey END)::VARCHAR AS value FROM supplier
    UNION ALL SELECT 'x_p' || s_suppkey, (s_nationkey + 100)::VARCHAR FROM supplier WHERE s_suppkey % 3 = 0""",
)
def p29(spark, d):
    """A parameter a supplier; every third one has a value of its own for class x."""
    s = table(spark, d, "supplier")
    plain = s.select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").cast("string").alias("value"))
    own = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("x_p"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_nationkey") + 100).cast("string").alias("value"))
    return C.parameters_of(plain.unionByName(own), "x")


@query("a1_label_sets", f"WITH {_SETS} SELECT id, array_to_string(labels, ',') AS labels FROM sets")
def a1(spark, d):
    return _sets(spark, d).select("id", L.stratum(F.col("labels")).alias("labels"))


@query("a2_nonnull_counts", "SELECT l_orderkey, l_suppkey, count(nullif(l_returnflag, 'A')) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey")
def a2(spark, d):
    li = table(spark, d, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    return L.nonnull_counts(li, ["l_orderkey", "l_suppkey"], "flag")


@query("a3_single_valued", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT nullif(l_returnflag, 'A')) = 1")
def a3(spark, d):
    li = table(spark, d, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    return L.single_valued(li, ["l_orderkey"], "flag")


@query("a4_set_counts", f"WITH {_SETS} SELECT array_to_string(labels, ',') AS labels, n, unnest(labels) AS label FROM (SELECT labels, count(*) AS n FROM sets GROUP BY labels HAVING count(*) >= 10)")
def a4(spark, d):
    return L.set_counts(_sets(spark, d)).withColumn("labels", L.stratum(F.col("labels")))


@query("a5_value_counts", "SELECT status, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS status FROM orders) WHERE status IS NOT NULL GROUP BY status")
def a5(spark, d):
    return L.value_counts(table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status")), "status")


@query(
    "a6_major_class_distribution",
    f"""WITH {_SETS}, c AS (SELECT labels[1] AS class, id % 5 AS fold, count(*) AS n FROM sets WHERE len(labels) = 1 GROUP BY ALL),
    frame AS (SELECT f.fold, k.class FROM (SELECT DISTINCT id % 5 AS fold FROM sets) f CROSS JOIN (VALUES ('A'), ('N'), ('R'), ('X')) k(class))
    SELECT fold, class, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY fold), 6) AS share FROM frame LEFT JOIN c USING (fold, class)""",
)
def a6(spark, d):
    classes = spark.createDataFrame([(x,) for x in "ANRX"], "class string")
    return rounded(L.major_class_distribution(_sets(spark, d).withColumn("fold", F.col("id") % 5), classes, ["fold"]), "share")


@query("a7_cooccurrence", "SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS n FROM customer GROUP BY ALL")
def a7(spark, d):
    return L.cooccurrence(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query(
    "a8_unsplittable",
    """WITH g AS (SELECT p_type || p_size AS target, p_brand, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL), t AS (SELECT p_type || p_size AS target, count(*) AS total FROM part GROUP BY ALL)
    SELECT target FROM t JOIN (SELECT target, max(n) AS most FROM g GROUP BY target) USING (target) WHERE most / total > 0.25 OR total < 5""",
)
def a8(spark, d):
    p = table(spark, d, "part").withColumn("target", F.concat("p_type", "p_size"))
    return L.unsplittable(p, "p_brand", "target", "p_partkey", 5, 0.25)


@query(
    "a13_ensemble_mean",
    """SELECT id, replace(class, '-', '_') AS class, round(sum(score) / 2, 6) AS score FROM (
      SELECT vec_id AS id, 'a-b' AS class, embedding[1]::DOUBLE AS score FROM embeddings UNION ALL SELECT vec_id, 'a-b', embedding[2]::DOUBLE FROM embeddings
      UNION ALL SELECT vec_id, 'c', embedding[3]::DOUBLE FROM embeddings) GROUP BY ALL""",
)
def a13(spark, d):
    from ..operators.learning import ensemble_mean

    e = table(spark, d, "embeddings")
    one = lambda k, c: e.select(F.col("vec_id").alias("id"), F.lit(c).alias("class"), F.col("embedding")[k].cast("double").alias("score"))
    rows = one(0, "a-b").unionByName(one(1, "a-b")).unionByName(one(2, "c")).unionByName(one(3, L.UNKNOWN))
    return rounded(ensemble_mean(rows, 2), "score")


@query("a14_max_score_or_default", "SELECT user_id, coalesce(max(CASE WHEN event_type = 'error' AND value > 80 THEN value END), -1000000) AS score FROM events GROUP BY user_id")
def a14(spark, d):
    e = table(spark, d, "events")
    best = e.where("event_type = 'error' and value > 80").groupBy("user_id").agg(F.max("value").alias("score"))
    return e.select("user_id").distinct().join(best, "user_id", "left").withColumn("score", F.coalesce("score", F.lit(-1000000.0)))


@query(
    "a15_confidence_pivot",
    """WITH m AS (SELECT user_id, event_type, max(10 - value) AS conf FROM events GROUP BY ALL)
    SELECT user_id, round(coalesce(max(conf) FILTER (event_type = 'click'), 0), 6) AS click, round(coalesce(max(conf) FILTER (event_type = 'view'), 0), 6) AS view,
           round(greatest(coalesce(max(conf) FILTER (event_type = 'click'), 0), coalesce(max(conf) FILTER (event_type = 'view'), 0)), 6) AS detected FROM m GROUP BY user_id""",
)
def a15(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", (10 - F.col("value")).alias("conf"))
    wide = R.pivoted(e, ["user_id"], "event_type", ["click", "view"], "conf")
    return rounded(wide.withColumn("detected", F.greatest("click", "view")), "click", "view", "detected")


@query("a16_cluster_counts", "SELECT label, vec_id % 3 AS part, count(*) AS n FROM embeddings GROUP BY ALL HAVING count(*) > 1")
def a16(spark, d):
    from ..operators.clustering import cluster_counts

    return cluster_counts(table(spark, d, "embeddings").withColumn("part", F.col("vec_id") % 3), ["label", "part"], 2)


@query(
    "a17_union_of_top_k",
    """SELECT DISTINCT l_partkey FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_suppkey % 5 ORDER BY q DESC, l_partkey) AS k
      FROM (SELECT l_suppkey % 5 AS l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)) WHERE k <= 20""",
)
def a17(spark, d):
    li = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fold"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return R.union_of_top_k(li, "fold", "l_partkey", "q", 20)


@query("a18_masked_mean", "SELECT vec_id, round(list_avg(list_transform(embedding[2:63], lambda x: x::DOUBLE)), 6) AS mean FROM embeddings")
def a18(spark, d):
    inner = F.slice("embedding", 2, 62)
    total = F.aggregate(inner, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", r6(total / F.size(inner)).alias("mean"))


@query("a19_worker_count", "SELECT count(*) // 320 + 1 AS workers FROM documents")
def a19(spark, d):
    return table(spark, d, "documents").agg(F.expr("count(1) div 320 + 1").alias("workers"))


@query("a22_quartiles", "SELECT label, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3 FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def a22(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    return e.groupBy("label").agg(*[r6(F.percentile("x", F.lit(q))).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])


@query(
    "a23_fold_divergence",
    f"""WITH {_SETS}, c AS (SELECT id % 5 AS fold, array_to_string(labels, ',') AS k, count(*)::DOUBLE AS n FROM sets GROUP BY ALL),
    p AS (SELECT fold, k, n / sum(n) OVER (PARTITION BY fold) AS p FROM c), q AS (SELECT k, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY k),
    f AS (SELECT f.fold, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + q * ln(2 * q / (coalesce(p, 0) + q))) / 2))) AS js
      FROM (SELECT DISTINCT fold FROM c) f CROSS JOIN q LEFT JOIN p ON p.fold = f.fold AND p.k = q.k GROUP BY f.fold)
    SELECT round(avg(js), 6) AS mean, round(min(js), 6) AS low, round(max(js), 6) AS high FROM f""",
)
def a23(spark, d):
    rows = _sets(spark, d).select((F.col("id") % 5).alias("fold"), L.stratum(F.col("labels")).alias("k"))
    mine = rows.groupBy("fold", "k").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    whole = mine.groupBy("k").agg(F.sum("weight").alias("weight")).crossJoin(F.broadcast(mine.select("fold").distinct()))
    js = M.js_distance(mine, whole, ["fold"], "k")
    return js.agg(*[r6(f("js")).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))])


@query("u9_one_hot", f"WITH {_SETS} SELECT id, list_contains(labels, 'A')::INTEGER AS A, list_contains(labels, 'N')::INTEGER AS N FROM sets")
def u9(spark, d):
    return _sets(spark, d).select("id", *L.one_hot(F.col("labels"), ["A", "N"]))


@query(
    "n1_major_flag_nulls",
    """SELECT l_orderkey, count(*) AS lines, sum(CASE WHEN n <= 1 THEN CASE WHEN coalesce(lower(flag) <> 'n', true) THEN 1 ELSE 0 END ELSE CASE WHEN coalesce(lower(flag) = 'r', false) THEN 1 ELSE 0 END END)::BIGINT AS major
    FROM (SELECT l_orderkey, nullif(l_returnflag, 'A') AS flag, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey""",
)
def n1(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("A")).alias("flag"))
    sizes = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    flag = F.when(F.lower("flag") == "n", "no").when(F.lower("flag") == "r", "yes").otherwise(F.col("flag"))
    rows = li.join(sizes, "l_orderkey").withColumn("major", C.major_product(F.col("n"), flag).cast("long"))
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("major").alias("major"))


@query("f1_strings", "SELECT p_partkey, split_part(p_brand, '#', 2) AS second, split_part(trim(p_name), ' ', 1) AS first, replace(p_type, 'E', '-') AS dashed, CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 7) ELSE p_name END AS short, (length(p_name) - length(replace(p_name, 'e', '')))::INTEGER AS es FROM part")
def f1(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("second"), F.split_part(F.trim(n), F.lit(" "), F.lit(1)).alias("first"), F.translate("p_type", "E", "-").alias("dashed"), C.truncated(n, 9, 7).alias("short"), (F.length(n) - F.length(F.replace(n, F.lit("e"), F.lit("")))).alias("es"))


@query("f2_casts", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_size || 'A' ELSE p_size || '' END AS INTEGER) AS residue FROM part")
def f2(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("A"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.try_cast("int").alias("residue"))


@query("f3_math", "SELECT label, round(stddev_pop(x), 6) AS sd0, round(stddev_samp(x), 6) AS sd1, round(var_samp(x), 6) AS v1, round(max(sqrt(abs(x))), 6) AS root, round_even(sum(x), 0) + 0 AS half_even FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def f3(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    return e.groupBy("label").agg(r6(F.stddev_pop("x")).alias("sd0"), r6(F.stddev_samp("x")).alias("sd1"), r6(F.var_samp("x")).alias("v1"), r6(F.max(F.sqrt(F.abs("x")))).alias("root"), (F.bround(F.sum("x"), 0) + 0.0).alias("half_even"))


@query(
    "f4_sets",
    f"""WITH {_SETS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(labels, ['R', 'X']))), ',') AS united, array_to_string(list_sort(list_intersect(labels, ['A', 'R'])), ',') AS common,
    array_to_string(list_filter(labels, lambda x: x <> 'A'), ',') AS rest, len(labels)::INTEGER AS n FROM sets""",
)
def f4(spark, d):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return _sets(spark, d).select("id", text(F.array_union("labels", arr("R", "X"))).alias("united"), text(F.array_intersect("labels", arr("A", "R"))).alias("common"), text(F.array_except("labels", arr("A"))).alias("rest"), F.size("labels").alias("n"))


@query("f5_maps", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS word FROM nation")
def f5(spark, d):
    names = F.create_map(F.lit(0), F.lit("zero"), F.lit(1), F.lit("one"))
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(F.try_element_at(names, F.col("n_regionkey").cast("int")), F.lit("many")).alias("word"))


@query("f6_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f6(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("f7_dates", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def f7(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp"))


@query("f10_reactants", "SELECT p_partkey, array_to_string(string_split(string_split(replace(p_name, ' ', '.') || '>>' || p_type, '>>')[1], '.'), '+') AS parts FROM part")
def f10(spark, d):
    p = table(spark, d, "part").withColumn("rxn", F.concat(F.translate("p_name", " ", "."), F.lit(">>"), "p_type"))
    return p.select("p_partkey", F.array_join(R.reactants("rxn"), "+").alias("parts"))


@query("f12_bins", "SELECT vec_id, CAST(10 - floor(vec_id / ((SELECT max(vec_id) FROM embeddings) / 10.0::DOUBLE)) AS BIGINT) AS bin FROM embeddings")
def f12(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    most = F.broadcast(e.agg(F.max("vec_id").alias("most")))  # one row
    return e.join(most).select("vec_id", (F.lit(10) - F.floor(F.col("vec_id") / (F.col("most") / F.lit(10.0)))).cast("long").alias("bin"))


@query("f13_bytes_to_text", "SELECT n_nationkey, n_name AS name FROM nation")
def f13(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.decode(F.encode("n_name", "UTF-8"), "UTF-8").alias("name"))


@query("f8_canonical_texts")
def f8(spark, d):
    """Every part stands for a substrate; parts are counted by their substrate's canonical text."""
    texts = sorted(set(SUBSTRATES.values()))
    p = table(spark, d, "part").select(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod("p_partkey", F.lit(len(texts))) + 1).cast("int")).alias("smiles"))
    return canonical(p, "smiles", "canonical").groupBy("smiles", "canonical").agg(F.count(F.lit(1)).alias("n"))
