"""Filters over parsed prices ask for columns that are worked out once."""

from pyspark.sql import functions as F

from quern.functions.prices import SHAPES, parse_prices
from quern.functions.text import settled


def test_a_filter_does_not_repeat_the_parser(spark):
    texts = ["4.50", "1,250.00", "450$", "3/$9.00", "8.80/1000g", "sold out", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, raw string")
    lost = parse_prices(df, {"": "raw"}).where(F.col("unit_price").isNull() & (F.col("offer_type") != "blank")).select("i")
    plan = lost._jdf.queryExecution().optimizedPlan().toString()
    # each shape's pattern once, and the plain number's once more where it is read
    assert plan.count("RLIKE(") <= len(SHAPES) + 2
    assert [r.i for r in lost.collect()] == [5]


def test_settled_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, "y")], "a long, b string, `c.d` string").withColumn("e", F.upper("b"))
    got = settled(df, ["e", "b"])
    assert sorted(got.columns) == sorted(df.columns)
    assert got.select("a", "b", "`c.d`", "e").exceptAll(df.select("a", "b", "`c.d`", "e")).isEmpty() and got.count() == 3
