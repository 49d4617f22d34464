from pyspark.sql import functions as F

from quern.functions import units as U
from quern.plans.registry import queries


def test_staged_fields_equal_the_expressions(spark):
    texts = [None, "", "n/a", "4 x 100g", "60gx6", "1.5 KG", "12 per pack", "3 trays", "7 bag", "24ea", "2 fl oz", "500mlx", "1 lb 2 oz", "x3", "5 box", "999" * 120 + " pack"]
    df = spark.createDataFrame([(t,) for t in texts], "units string")
    got = U.parse_folded(df.withColumns({"q": U.folded_quantity(F.col("units")), "c": U.folded_class(F.col("units"))}), "units").collect()
    assert len(got) == len(texts) and all((r.quantity, r["class"]) == (r.q, r.c) for r in got)


def test_each_pattern_is_looked_for_once(spark):
    plan = queries()["up_folded"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(U.TOKEN) == 1 == plan.count(U.SIZE)
