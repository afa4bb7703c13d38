from zymolith.functions.scratch import clear_scratch, scratch_dir, written


def test_written_tables_and_clearing(spark):
    df = written(spark.range(5).selectExpr("id", "id % 2 as odd"), "probe", "odd")
    assert scratch_dir(spark) and sorted(r.id for r in df.collect()) == list(range(5))
    assert clear_scratch(spark) >= 1 and clear_scratch(spark) == 0
    again = written(spark.range(3), "probe")
    assert again.count() == 3


def test_buckets_are_joined_where_they_lie(spark):
    from zymolith.functions.scratch import bucketed

    whole = bucketed(spark.range(500).selectExpr("id AS pack", "repeat('x', 100) AS blob"), "buckets", "pack")
    some = spark.range(0, 500, 3).selectExpr("id AS pack", "1 AS found").hint("shuffle_hash")
    out = whole.join(some, "pack", "left")
    assert out.where("found = 1").count() == 167 and out.count() == 500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = whole.join(some, "pack", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan
