"""The index finds what the scan finds, for texts of any length, without reading all names."""

import random

import pytest
from pyspark.sql import functions as F

from quern.plans import publication as P


@pytest.fixture(scope="module")
def products(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aabbcé ß") for _ in range(rng.randrange(0, 9)))
    rows = [(f"{i:05d}", word(), rng.choice([None, "AA", "b c"]), rng.choice([None, "5 g", "aaa"]), (rng.randrange(3),)) for i in range(600)] + [("x", "Aaaaaaa", None, None, (1,)), ("y", "", None, None, (2,))]
    return spark.createDataFrame(rows, "gtin14 string, name string, brand string, size string, comparison struct<n_compared: long>")


@pytest.fixture(scope="module")
def path(products, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    P.index(products, path)
    return path


TEXTS = ["a", "é", "ab", "AA", "aab", "aaa", "aaaa", "b c", "5 g", "ß ", "a b", "ca é", "aaaaaaa", "aaaaaaaa", "b c 5 g", "absent", " ", "%", "_a"]


@pytest.mark.parametrize("text", TEXTS)
def test_index_equals_scan(spark, products, path, text):
    for most in (3, 10_000):
        assert [tuple(r) for r in P.search_index(spark, path, text, most).collect()] == [tuple(r) for r in P.search(products, text, most).collect()]


def test_filters_reach_the_postings(spark, path):
    plan = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(["aab", "abc"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan
    for text in ("a", "aab "):
        plan = P.search_index(spark, path, text)._jdf.queryExecution().executedPlan().toString()
        assert "gtin14" in plan.split("PushedFilters")[1] and "postings" not in plan
