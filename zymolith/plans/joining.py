"""Join, order, sampling and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.running import ordinals
from ..operators import blocks as B
from ..operators import pairs as P
from ..operators import relations as R
from .registry import query, r6, table


@query("j1_features_join", "SELECT vec_id, quality, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings JOIN labels ON doc_id = vec_id")
def j1(spark, d):
    e, lab = table(spark, d, "embeddings"), table(spark, d, "labels")
    return e.join(lab, F.col("doc_id") == F.col("vec_id")).select("vec_id", "quality", r6(F.col("embedding")[0].cast("double")).alias("x"))


@query(
    "j2_impute_mean",
    """WITH m AS (SELECT avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b FROM embeddings WHERE vec_id % 3 <> 0)
    SELECT doc_id, round(coalesce(e.embedding[1]::DOUBLE, m.a), 6) AS a, round(coalesce(e.embedding[2]::DOUBLE, m.b), 6) AS b
    FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 <> 0) e ON doc_id = vec_id CROSS JOIN m""",
)
def j2(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = R.left_impute_mean(table(spark, d, "documents").select("doc_id"), e, "doc_id")
    return out.select("doc_id", r6(F.col("embedding")[0]).alias("a"), r6(F.col("embedding")[1]).alias("b"))


@query("j3_impute_zero", "SELECT doc_id, round(coalesce(embedding[1]::DOUBLE, 0), 6) AS a, coalesce(len(embedding), 64)::INTEGER AS n FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 <> 0) ON doc_id = vec_id")
def j3(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = R.left_impute_zero(table(spark, d, "documents").select("doc_id"), e, "doc_id", "embedding", 64)
    return out.select("doc_id", r6(F.col("embedding")[0]).alias("a"), F.size("embedding").alias("n"))


@query("j4_first_row_join", "SELECT DISTINCT c.conv_id, f.text AS opening FROM conversations c JOIN (SELECT conv_id, first(text ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id) f USING (conv_id)")
def j4(spark, d):
    c = table(spark, d, "conversations")
    first = R.first_per_key(c, ["conv_id"], ["turn", "role", "text"])
    return c.select("conv_id").distinct().join(first.select("conv_id", F.col("text").alias("opening")), "conv_id")


@query(
    "j5_replace_column",
    """SELECT a.p_partkey, b.price FROM part a JOIN (SELECT nullif(p_brand, 'Brand#4') AS b1, p_type AS b2, p_size AS b3, max(p_retailprice) AS price FROM part GROUP BY ALL) b
    ON nullif(a.p_brand, 'Brand#4') IS NOT DISTINCT FROM b.b1 AND a.p_type = b.b2 AND a.p_size = b.b3""",
)
def j5(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#4")).alias("brand"), "p_type", "p_size", F.col("p_retailprice").alias("price"))
    top = p.groupBy("brand", "p_type", "p_size").agg(F.max("price").alias("price"))
    return R.replace_column(p, top, ["brand", "p_type", "p_size"], "price").select("p_partkey", "price")


@query("j6_train_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def j6(spark, d):
    ids = table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return R.semi(table(spark, d, "orders"), ids, ["o_custkey"]).select("o_orderkey")


@query("j7_negatives_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j7(spark, d):
    ids = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.anti(table(spark, d, "customer"), ids, ["c_custkey"]).select("c_custkey")


@query("j8_zero_rows", "SELECT doc_id AS vec_id, round(coalesce(e.embedding[1]::DOUBLE, 0), 6) AS a FROM labels LEFT JOIN embeddings e ON vec_id = doc_id UNION ALL SELECT vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def j8(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return R.with_zero_rows(e, ids, "vec_id", "embedding", 64).select("vec_id", r6(F.col("embedding")[0]).alias("a"))


@query(
    "j9_lookup_chain",
    """WITH c AS (SELECT s_suppkey AS class, s_nationkey AS reaction FROM supplier),
    dd AS (SELECT class, coalesce(n_regionkey + 100, reaction) AS r FROM c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n_nationkey = reaction),
    t AS (SELECT n_nationkey AS r, n_name || '.x>>y' AS text FROM nation UNION ALL SELECT r_regionkey + 100, r_name || '>>z' FROM region)
    SELECT class, array_to_string(list_sort(list_distinct(flatten(list(string_split(string_split(text, '>>')[1], '.'))))), ',') AS substrates FROM dd JOIN t USING (r) GROUP BY class""",
)
def j9(spark, d):
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    classes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("class"), F.col("s_nationkey").alias("_r"))
    reactions = classes.select("class", F.col("_r").alias("reaction"))
    directed = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("reaction"), (F.col("n_regionkey") + 100).alias("directed"))
    texts = n.select(F.col("n_nationkey").alias("reaction"), F.concat("n_name", F.lit(".x>>y")).alias("text")).unionByName(g.select((F.col("r_regionkey") + 100).alias("reaction"), F.concat("r_name", F.lit(">>z")).alias("text")))
    out = R.lookup_chain(classes.select("class"), reactions, directed, texts)
    return out.select("class", F.array_join("substrates", ",").alias("substrates"))


@query(
    "j10_set_overlap_join",
    """WITH h AS (SELECT l_orderkey AS id, l_returnflag AS class, max(l_quantity) AS conf, max(l_linenumber * 1000000 + l_partkey) AS ordinal FROM lineitem GROUP BY ALL),
    s AS (SELECT * FROM (VALUES ('A', 'x'), ('A', 'y'), ('N', 'y'), ('R', 'z')) v(class, substrate) WHERE substrate IN ('x', 'y'))
    SELECT id, substrate, arg_max(conf, ordinal) AS conf FROM h JOIN s USING (class) GROUP BY ALL""",
)
def j10(spark, d):
    li = table(spark, d, "lineitem")
    h = li.groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("class")).agg(F.max("l_quantity").alias("conf"), F.max(F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"))
    sets = spark.createDataFrame([("A", ["x", "y"]), ("N", ["y"]), ("R", ["z"])], "class string, substrates array<string>")
    return R.set_overlap(h, sets, spark.createDataFrame([("x",), ("y",)], "substrate string"))


_VEC = "vec AS (SELECT vec_id, label, embedding FROM embeddings)"
_DOT = "list_sum(list_transform(range(1, 65), lambda k: {a}[k]::DOUBLE * {b}[k]::DOUBLE))"
_COS = f"{_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')}))"
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) * (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE))))"


def _vec(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("j11_pair_triangle", f"WITH {_VEC} SELECT a.vec_id AS i, b.vec_id AS j, round({_COS}, 6) AS score FROM vec a JOIN vec b ON a.vec_id < b.vec_id")
def j11(spark, d):
    return P.vector_pairs(_vec(spark, d), "cosine", value="score", places=6)


@query(
    "j12_pair_cache",
    f"""WITH {_VEC} SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN (a.vec_id + b.vec_id) % 4 = 0 THEN -1.0::DOUBLE ELSE round({_COS}, 6) END AS score FROM vec a JOIN vec b ON a.vec_id < b.vec_id""",
)
def j12(spark, d):
    """Every fourth pair is known, under (j, i), and carries a mark instead of a score."""
    v = _vec(spark, d)
    pairs = P.triangle(v.select("id"), "id")
    known = pairs.where((F.col("i") + F.col("j")) % 4 == 0).select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(-1.0).alias("score"))
    return P.with_cached(v, known, "cosine", places=6)


_PARTS = "parts AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS sid, l_partkey % 40 AS item FROM lineitem)"


def _parts(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("sid"), (F.col("l_partkey") % 40).alias("item")).distinct()


@query(
    "j13_recall_overlap",
    f"""WITH {_PARTS}, n AS (SELECT file, sid, count(*) AS n FROM parts GROUP BY ALL)
    SELECT a.file, a.sid AS new_id, b.sid AS known_id FROM parts a JOIN parts b ON a.file = b.file AND a.item = b.item AND a.sid > 3 AND b.sid <= 3 JOIN n ON n.file = a.file AND n.sid = a.sid
    GROUP BY a.file, a.sid, b.sid HAVING count(*) / max(n.n) >= 0.5""",
)
def j13(spark, d):
    p = _parts(spark, d)
    new, known = p.where("sid > 3").withColumnRenamed("sid", "new_id"), p.where("sid <= 3").withColumnRenamed("sid", "known_id")
    return R.recall_overlap(new, known, ["file"], "item")


@query(
    "j14_priority_merge",
    f"""WITH {_PARTS}, n AS (SELECT file, sid, count(*) AS n FROM parts GROUP BY ALL),
    p1 AS (SELECT * FROM parts WHERE sid = 1),
    x2 AS (SELECT DISTINCT a.file, a.sid FROM parts a JOIN p1 b ON a.file = b.file AND a.item = b.item AND a.sid = 2 JOIN n ON n.file = a.file AND n.sid = a.sid GROUP BY a.file, a.sid, b.sid HAVING count(*) / max(n.n) >= 0.5),
    p2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM parts p WHERE sid = 2 AND NOT EXISTS (SELECT 1 FROM x2 WHERE x2.file = p.file AND x2.sid = p.sid)),
    x3 AS (SELECT DISTINCT a.file, a.sid FROM parts a JOIN p2 b ON a.file = b.file AND a.item = b.item AND a.sid = 3 JOIN n ON n.file = a.file AND n.sid = a.sid GROUP BY a.file, a.sid, b.sid HAVING count(*) / max(n.n) >= 0.5),
    p3 AS (SELECT * FROM p2 UNION ALL SELECT * FROM parts p WHERE sid = 3 AND NOT EXISTS (SELECT 1 FROM x3 WHERE x3.file = p.file AND x3.sid = p.sid))
    SELECT file, sid, count(*) AS n FROM p3 GROUP BY ALL""",
)
def j14(spark, d):
    rows = _parts(spark, d).withColumn("grp", F.concat(F.lit("g"), "sid"))
    return R.priority_merge(rows, ["g1", "g2", "g3"], ["file"], "grp", "sid", "item").groupBy("file", "sid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j17_nearest_vote",
    f"""WITH {_VEC}, nn AS (SELECT a.vec_id AS i, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS k FROM vec a JOIN vec b ON a.vec_id <> b.vec_id),
    v AS (SELECT i, label, count(*) AS n, min(k) AS k FROM nn WHERE k <= 3 AND label <> 0 GROUP BY ALL)
    SELECT i AS id, first(label ORDER BY n DESC, k) AS label FROM v GROUP BY i""",
)
def j17(spark, d):
    v = _vec(spark, d)
    near = B.nearest(B.packed(v), 3)
    return P.neighbour_vote(near, v.select("id", "label"), noise=0)


@query(
    "j18_medoid_zones",
    f"""WITH {_VEC}, dd AS (SELECT a.vec_id AS id, b.vec_id AS m, {_DIST} AS d FROM vec a JOIN vec b ON b.vec_id < 5),
    r AS (SELECT id, m, row_number() OVER (PARTITION BY id ORDER BY d, m) AS k FROM dd WHERE d < 1.2)
    SELECT v.vec_id AS id, count(m) AS hits, max(m) FILTER (k = 1) AS first, max(m) FILTER (k = 2) AS second FROM vec v LEFT JOIN r ON r.id = v.vec_id GROUP BY v.vec_id""",
)
def j18(spark, d):
    v = _vec(spark, d)
    medoids = F.broadcast(v.where("id < 5").select(F.col("id").alias("medoid"), F.col("embedding").alias("b")))
    to = v.select("id", F.col("embedding").alias("a")).crossJoin(medoids).select("id", "medoid", P.euclidean().alias("d"))
    return P.medoid_zones(to, 1.2)


@query("j20_shard_join", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings WHERE vec_id % 11 = 0")
def j20(spark, d):
    from ..sources.tables import read_vector_shards

    e = table(spark, d, "embeddings").select((F.floor(F.col("vec_id") / 50)).alias("shard"), (F.col("vec_id") % 50).cast("int").alias("position"), "vec_id", "embedding")
    ids = e.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    wanted = e.where("vec_id % 11 = 0").select(F.col("vec_id").alias("id"))
    return read_vector_shards(ids, e.select("shard", "position", "embedding"), wanted).select("id", r6(F.col("embedding")[0].cast("double")).alias("x"))


@query("w8_first_per_key", "SELECT user_id, event_type, first(value ORDER BY ts, event_id) AS value FROM events GROUP BY ALL")
def w8(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return R.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("n3_last_per_key", "SELECT kind, last(value ORDER BY ts, event_id) AS value FROM (SELECT *, nullif(event_type, 'view') AS kind FROM events) WHERE kind IS NOT NULL GROUP BY kind")
def n3(spark, d):
    return R.last_value_per_key(table(spark, d, "events").withColumn("kind", F.nullif("event_type", F.lit("view"))), "kind", "value", ["ts", "event_id"])


@query("t1_sorted", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY c_acctbal DESC, c_custkey")
def t1(spark, d):
    ranked = ordinals(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], "place")
    return ranked.withColumn("place", F.col("place") + 1)


@query("t2_top_k_per_group", "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 200")
def t2(spark, d):
    out = R.top_k(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 200)
    return out.select("o_orderpriority", "o_orderkey", "rank")


@query("t4_two_key_sort", "SELECT l_suppkey, n, q, row_number() OVER (ORDER BY n DESC, q DESC, l_suppkey) AS place FROM (SELECT l_suppkey, count(*) AS n, first(l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY l_suppkey)")
def t4(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("q"))
    return ordinals(by, [F.desc("n"), F.desc("q"), "l_suppkey"], "place").withColumn("place", F.col("place") + 1)


@query("t5_two_smallest", "SELECT l_orderkey, round(l_extendedprice, 6) AS price, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS rank FROM lineitem) WHERE rank <= 2")
def t5(spark, d):
    return R.top_k(table(spark, d, "lineitem"), ["l_orderkey"], [F.asc("l_extendedprice")], 2).select("l_orderkey", r6("l_extendedprice").alias("price"), "rank")


@query("t8_limited_scan", "SELECT event_id FROM events WHERE event_id >= 100 AND event_id < 350")
def t8(spark, d):
    return R.ordinal_range(table(spark, d, "events"), "event_id", 100, 350).select("event_id")


@query("p17_ordinal_slices", "SELECT event_id // 1000 AS worker, count(*) AS n FROM events GROUP BY 1")
def p17(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("worker")).agg(F.count(F.lit(1)).alias("n"))


@query("u1_union", "SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def u1(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id")))


@query("u2_other_folds", "SELECT doc_id FROM labels WHERE doc_id % 5 <> 2")
def u2(spark, d):
    rows = table(spark, d, "labels").withColumn("fold", F.col("doc_id") % 5)
    train, test = R.other_folds(rows, 2), rows.where("fold = 2")
    R.assert_disjoint(train, test, ["doc_id"])
    return train.select("doc_id")


@query("u4_unprocessed", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(spark, d):
    return R.unprocessed(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("u5_uniform_sample", "SELECT 200::BIGINT AS n, 200::BIGINT AS ids, true AS inside")
def u5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    s = R.uniform_sample(o, 200, ["o_orderkey"], seed=7)
    inside = s.join(o, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("k"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("ids")).crossJoin(inside).select("n", "ids", (F.col("k") == 200).alias("inside"))


@query(
    "u6_downsample_negatives",
    """WITH p AS (SELECT count(DISTINCT doc_id) AS n FROM labels WHERE toxic = 1), k AS (SELECT CAST(floor(n / (1 - 0.8::DOUBLE) - n) AS BIGINT) AS most FROM p)
    SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) AS r FROM labels WHERE toxic = 0) JOIN k ON r <= most""",
)
def u6(spark, d):
    lab = table(spark, d, "labels")
    return R.downsample_negatives(lab, F.col("toxic") == 1, 0.8, "doc_id", (F.col("doc_id") * 7919) % 10007).select("doc_id")


@query("u7_melted", "SELECT doc_id, 'quality' AS class FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1")
def u7(spark, d):
    return R.melted(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])


@query("u8_pivoted", "SELECT user_id, coalesce(max(value) FILTER (event_type = 'click'), 0) AS click, coalesce(max(value) FILTER (event_type = 'error'), 0) AS error FROM events WHERE value > 90 GROUP BY user_id")
def u8(spark, d):
    e = table(spark, d, "events").where("value > 90")
    return R.pivoted(e, ["user_id"], "event_type", ["click", "error"], "value")


@query("u10_mirrored", f"WITH {_VEC} SELECT a.vec_id AS i, b.vec_id AS j, round({_DIST}, 6) AS d FROM vec a CROSS JOIN vec b")
def u10(spark, d):
    return P.vector_matrix(_vec(spark, d), places=6)


@query("u11_submatrix", f"WITH {_VEC} SELECT a.vec_id AS i, b.vec_id AS j, round({_DIST}, 6) AS d FROM vec a CROSS JOIN vec b WHERE a.label < 4 AND b.label < 4")
def u11(spark, d):
    v = _vec(spark, d)
    return P.vector_matrix(v, ids=v.where("label < 4").select("id"), places=6)


@query(
    "w10_carry_forward",
    """WITH e AS (SELECT event_id, value > 60 AS black, value % 10 < 3 AS sel FROM events)
    SELECT a.event_id FROM e a LEFT JOIN e b ON b.event_id = a.event_id - 1 WHERE NOT a.black AND (a.sel OR coalesce(b.black AND b.sel, false))""",
)
def w10(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") > 60).alias("black"), (F.col("value") % 10 < 3).alias("sel"))
    return R.carry_forward_sample(e, "event_id", "black", "sel").select("event_id")


@query("t7_stratum", "SELECT s, count(*) AS n FROM (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS s FROM lineitem GROUP BY l_orderkey) GROUP BY s")
def t7(spark, d):
    from ..operators.labels import label_sets, stratum

    return label_sets(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag").groupBy(stratum(F.col("labels")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
