"""Counts of ordered pairs against brute force, by lists, shares and blocks; and what they move."""

import random
from collections import Counter
from itertools import combinations

import pytest

from quern.operators import stats


@pytest.mark.parametrize(("block", "task"), [(2_000, 4_000_000), (2_000, 20), (4, 20)])
def test_pairs_are_counted_once(spark, block, task):
    rng = random.Random(7)
    rows = [(rng.choice("abcde"), rng.randrange(12)) for _ in range(90)] + [("f", 3), ("f", None), (None, 4), (None, 5), ("g", 1)]
    df = spark.createDataFrame(rows, "g string, k long")
    held = {g: sorted({k for h, k in rows if h == g and k is not None}) for g in "abcdefg"}
    want = Counter(p for ks in held.values() for p in combinations(ks, 2))
    got = [tuple(r) for r in stats.pair_counts(df, ["g"], "k", block, task).select("a", "b", "n").collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_no_pair_of_a_small_group_is_moved(spark):
    df = spark.range(4_000).selectExpr("id div 40 as g", "id % 40 as k")
    assert sum(r.n for r in stats.pair_counts(df, ["g"], "k").collect()) == 100 * 40 * 39 // 2
    plan = stats.pair_counts(df, ["g"], "k")._jdf.queryExecution().executedPlan().toString()
    # one exchange, of lists: pairs are made and counted behind it
    assert plan.count("Exchange") == 1 and "hashpartitioning(a" in plan and plan.index("explode(more") < plan.index("Exchange")
    assert stats.pair_counts(df.where("g < 0"), ["g"], "k").collect() == []
