"""Source, sink and streaming queries: round trips through files of the session's scratch folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..functions.running import ordinals
from ..operators import labels as L
from ..sources import tables as S
from ..sources import text_formats as X
from ..streaming.screening import hits, scored, screen_stream
from .registry import query, r6, rounded, table


def _folder(spark: SparkSession) -> str:
    return scratch_path(spark, "files")


@query("s1_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s1(spark, d):
    to = _folder(spark)
    S.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), to)
    return S.read_csv(spark, to, "c_custkey long, c_name string, c_acctbal double")


@query("s2_multiline_csv", "SELECT item_id, text FROM benchmark")
def s2(spark, d):
    to = _folder(spark)
    table(spark, d, "benchmark").select("item_id", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(to)
    return S.read_csv(spark, to, "item_id long, text string", complete=["item_id", "text"])


@query("s3_tsv_round_trip", "SELECT n_nationkey, n_name FROM nation")
def s3(spark, d):
    to = _folder(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.option("sep", "\t").csv(to)
    return S.read_tsv(spark, to, "n_nationkey int, n_name string", header=False)


@query("s5_commented_blacklist", "SELECT DISTINCT user_id AS id FROM events WHERE event_type IN ('error', 'signup')")
def s5(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.concat(F.lit("it is "), "event_type").alias("comment"))
    return S.commented_blacklist(e, parts=("error", "signup"))


@query("s6_fasta_round_trip", "SELECT (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS ordinal, 'item' || item_id AS id, regexp_replace(text, '\\s+', '', 'g') AS sequence FROM benchmark")
def s6(spark, d):
    to = _folder(spark)
    b = table(spark, d, "benchmark").orderBy("item_id").coalesce(1)
    X.write_fasta(b.select(F.concat(F.lit("item"), "item_id", F.lit(" text")).alias("id"), F.col("text").alias("sequence")), to)
    return X.read_fasta(spark, to).select("ordinal", "id", "sequence")


@query("s9_vectors_first_row", "SELECT id, round(min(x), 6) AS x FROM (SELECT vec_id // 2 AS id, embedding[1]::DOUBLE AS x, row_number() OVER (PARTITION BY vec_id // 2 ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1 GROUP BY id")
def s9(spark, d):
    to = _folder(spark)
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("key"), "vec_id", "embedding")
    S.write_vectors(e, to, 300)
    return S.read_vectors(spark, to, "key", "embedding", "vec_id").select("id", r6(F.col("embedding")[0].cast("double")).alias("x"))


@query("s15_json_hits", "SELECT 'u' || user_id AS name, max(value) AS score FROM events GROUP BY user_id")
def s15(spark, d):
    to = _folder(spark)
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("score"))
    S.write_hits(e.select(F.concat(F.lit("u"), "user_id", F.lit(" rest/of")).alias("id"), "score"), to)
    return spark.read.schema("name string, score double").json(to)


@query("s18_hit_table", "SELECT user_id || '' AS id, max(value) AS score FROM events GROUP BY user_id")
def s18(spark, d):
    to = _folder(spark)
    e = table(spark, d, "events")
    line = F.concat_ws("   ", F.col("user_id").cast("string"), F.lit("-"), "event_type", F.lit("-"), F.lit("1e-9"), F.col("value").cast("string"), F.lit("0.0"))
    e.select(line.alias("value")).unionByName(spark.createDataFrame([("# a comment",)], "value string")).write.text(to)
    return X.read_hits(spark, to).groupBy("id").agg(F.max("score").alias("score"))


@query("s21_distinct_and_runs", "SELECT count(DISTINCT event_type) AS kinds, (SELECT count(*) FROM (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type) AS runs FROM events")
def s21(spark, d):
    e = table(spark, d, "events")
    return S.distinct_count(e, "event_type").select(F.col("n").alias("kinds")).crossJoin(S.run_count(e, "event_type", "event_id").select(F.col("n").alias("runs")))


@query("k3_fold_store", "SELECT doc_id, 'fold_' || (doc_id % 5) AS fold FROM labels WHERE doc_id % 5 = 3")
def k3(spark, d):
    to = _folder(spark)
    rows = table(spark, d, "labels").select("doc_id", F.nullif(F.lit("x"), F.lit("x")).alias("note"), F.lit("random").alias("split"), F.concat(F.lit("fold_"), (F.col("doc_id") % 5).cast("string")).alias("fold"))
    S.write_folds(rows, to)
    return S.read_fold(spark, to, "random", "fold_3").select("doc_id", "fold")


@query("k5_gathered_hits", "SELECT user_id, event_id, value FROM events WHERE value >= 99 ORDER BY value DESC")
def k5(spark, d):
    return S.gathered(table(spark, d, "events").where("value >= 99").withColumn("id", F.col("event_id")), "value").select("user_id", "event_id", "value")


@query("k6_fasta_ordinals", "SELECT (row_number() OVER (ORDER BY item_id) - 1)::VARCHAR AS header, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::INTEGER AS n FROM benchmark")
def k6(spark, d):
    """Letters of all items, without ids: the ordinal is the header."""
    to = _folder(spark)
    rows = ordinals(table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence")), ["item_id"], "ordinal")
    X.write_fasta(rows, to, id_col=None)
    return X.read_fasta(spark, to).select("header", F.length("sequence").alias("n"))


CLASSES = ["isTPS", "c-1"]


def _model():
    """Two scores of a text: its length and its share of letters e; stands for a trained model."""
    return lambda texts: [(min(len(t) / 400, 1.0), t.count("e") / max(len(t), 1)) for t in texts]


_HITS = """s AS (SELECT item_id, CASE WHEN length(text) > 1022 THEN substr(text, 1, 1020) ELSE text END AS t FROM benchmark),
hits AS (SELECT 'item' || item_id AS name, round(least(length(t) / 400.0::DOUBLE, 1), 6) AS isTPS, round((length(t) - length(replace(t, 'e', '')))::DOUBLE / length(t), 6) AS c_1 FROM s WHERE least(length(t) / 400.0::DOUBLE, 1) >= 0.5)"""


def _screened(sequences):
    return hits(scored(sequences, _model, CLASSES), 1, CLASSES, 0.5)


@query("x2_screening_batch", f"WITH {_HITS} SELECT name, isTPS, c_1 FROM hits")
def x2(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("item"), "item_id", F.lit(" x")).alias("id"), F.col("text").alias("sequence"))
    return rounded(_screened(b), "isTPS", "c_1").select("name", "isTPS", "c_1")


@query("x2_screening_stream", f"WITH {_HITS} SELECT name, isTPS, c_1 FROM hits")
def x2s(spark, d):
    """The batch plan over a stream of files, run twice: the second run finds nothing left to do."""
    source, sink, marks = _folder(spark), _folder(spark), _folder(spark)
    b = table(spark, d, "benchmark").select(F.concat(F.lit("item"), "item_id", F.lit(" x")).alias("id"), F.col("text").alias("sequence"))
    b.repartition(4).write.parquet(source)
    for _ in range(2):
        screen_stream(spark, source, "id string, sequence string", _screened, sink, marks, files_a_batch=2)
    return rounded(spark.read.parquet(sink), "isTPS", "c_1").select("name", "isTPS", "c_1")


@query("x3_resume_anti_join", "SELECT item_id FROM benchmark WHERE item_id % 3 <> 0")
def x3(spark, d):
    b = table(spark, d, "benchmark")
    return b.join(b.where("item_id % 3 = 0").select("item_id"), "item_id", "left_anti").select("item_id")


@query("v2_bars", "SELECT lang, round(avg(x), 6) AS mean, round(avg(x) - (avg(x) - stddev_samp(x)), 6) AS error FROM (SELECT lang, n_chars / 1000.0::DOUBLE AS x FROM documents) GROUP BY lang")
def v2(spark, d):
    rows = table(spark, d, "documents").select("lang", (F.col("n_chars") / 1000.0).alias("x"))
    out = rows.groupBy("lang").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return rounded(out.select("lang", "mean", (F.col("mean") - (F.col("mean") - F.col("sd"))).alias("error")), "mean", "error")


@query("v3_values_by_type", "SELECT c_custkey, n_name AS type, c_acctbal AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
def v3(spark, d):
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("type")))
    return table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", "type", F.col("c_acctbal").alias("value"))


@query("v4_values_by_category", "SELECT o_orderpriority AS category, o_orderstatus AS class, count(*) AS n FROM orders GROUP BY ALL")
def v4(spark, d):
    o = table(spark, d, "orders").select(F.concat_ws("_|_", "o_orderpriority", "o_orderstatus").alias("name"))
    cut = F.instr("name", F.lit("_|_"))
    checked = F.when(cut > 0, F.col("name")).otherwise(F.raise_error(F.lit("a name without a category")).cast("string"))
    o = o.withColumn("name", checked)
    return o.groupBy(F.split_part("name", F.lit("_|_"), F.lit(1)).alias("category"), F.split_part("name", F.lit("_|_"), F.lit(2)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("v5_score_by_size", "SELECT l_orderkey, count(*)::INTEGER AS mapped, round(max(l_discount), 6) AS score FROM (SELECT DISTINCT l_orderkey, l_partkey, max(l_discount) OVER (PARTITION BY l_orderkey) AS l_discount FROM lineitem) GROUP BY l_orderkey")
def v5(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"), F.max("l_discount").alias("score"))
    return li.select("l_orderkey", F.size("parts").alias("mapped"), r6("score").alias("score"))


@query("v6_point_markers", "SELECT id, n, CASE WHEN n = 1 THEN labels[1] ELSE labels[1] || '/' || labels[2] END AS marker FROM (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_returnflag))) AS labels, len(list_distinct(list(l_returnflag)))::INTEGER AS n FROM lineitem GROUP BY l_orderkey) WHERE n <= 2")
def v6(spark, d):
    sets = L.label_sets(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag").where(F.size("labels") <= 2)
    return sets.select(F.col("l_orderkey").alias("id"), F.size("labels").alias("n"), F.array_join("labels", "/").alias("marker"))
