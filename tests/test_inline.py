from quern.plans.registry import queries


def test_a_look_up_moves_no_row_of_the_large_side(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries()["rl27_bucket_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
