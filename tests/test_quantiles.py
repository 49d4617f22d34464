"""Exact quantiles, of small groups and of groups that no task may sort, against numpy."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import stats

PS = {"low": 0.0, "p1": 0.01, "mid": 0.5, "p9": 0.9, "p998": 0.998, "high": 1.0}


def want(rows, ps):
    groups = defaultdict(list)
    for *g, v in rows:
        groups[tuple(g)].append(v)
    out = {}
    for g, values in groups.items():
        values = [v for v in values if v is not None]
        out[g] = tuple(float(np.quantile(values, p)) if values else None for p in ps.values())
    return out


def close(got, expected):
    assert set(got) == set(expected)
    for g, values in expected.items():
        for a, b in zip(got[g], values):
            assert a == b or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b)), (g, got[g], values)


def draw(rng, kind):
    return {"spread": rng.random() * 1e6, "ties": float(rng.randrange(5)), "hot": 3.0 if rng.random() < 0.7 else rng.gauss(3, 1), "wide": rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "same": 7.5}[kind]


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "wide", "same"])
def test_groups_of_all_sizes(spark, kind):
    rng = random.Random(kind)
    rows = [(g, b, draw(rng, kind)) for g, n in (("large", 9000), ("mid", 700), ("one", 1), (None, 1500)) for b in (True,) for _ in range(n)]
    rows += [("mid", False, draw(rng, kind)) for _ in range(3)] + [("none", True, None)] * 3 + [("large", True, None)] * 900
    df = spark.createDataFrame(rows, "g string, b boolean, v double").withColumn("n", F.lit("clash")).withColumn("k", F.lit("clash"))
    for limit in (100, 1_000_000):
        found = stats.quantiles(df, ["g", "b"], {name: ("v", p) for name, p in PS.items()}, limit=limit)
        assert found.columns == ["g", "b", *PS]
        close({tuple(r)[:2]: tuple(r)[2:] for r in found.collect()}, want(rows, PS))


def test_one_group_of_all_rows_and_two_columns(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.randrange(10**6)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "x double, y long")
    (r,) = stats.quantiles(df, [], {"a": ("x", 0.3), "b": ("y", 0.7), "c": ("x", 0.5)}, limit=50).collect()
    assert np.allclose(tuple(r), (np.quantile([x for x, _ in rows], 0.3), np.quantile([y for _, y in rows], 0.7), np.quantile([x for x, _ in rows], 0.5)), rtol=1e-12)
    assert tuple(stats.quantiles(df.limit(0), [], {"a": ("x", 0.3)}).first()) == (None,)
    assert stats.quantiles(df.limit(0), ["y"], {"a": ("x", 0.3)}).count() == 0


@pytest.mark.parametrize("kind", ["spread", "hot", "ties", "wide"])
def test_no_task_sorts_more_values_than_allowed(spark, kind):
    rng = random.Random(3)
    values = sorted(draw(rng, kind) for _ in range(20_000))
    rows = spark.createDataFrame([(0, v) for v in values], "g int, v double")
    targets = spark.createDataFrame([(0, k, 20_000) for k in (0, 1, 7_777, 10_000, 19_998, 19_999)], "g int, k long, n long")
    state = stats.narrowed(rows, ["g"], targets, 300).collect()
    for r in state:
        lo, hi = -np.inf if r.lo is None else r.lo, np.inf if r.hi is None else r.hi
        assert lo <= values[r.k] <= hi and r.below == sum(v < lo for v in values) and r.at_lo == sum(v == lo for v in values) and r.inside == sum(lo < v < hi for v in values)
        assert r.inside <= 300 or not 0 <= r.k - r.below - r.at_lo < r.inside
    assert {(r.k, r.v) for r in stats.selected(rows, ["g"], targets, 300).collect()} == {(r.k, values[r.k]) for r in state}


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_pairs_of_a_hot_group_come_once_each_way(spark, block):
    rng = random.Random(block)
    rows = [("hot", i, rng.random()) for i in range(300)] + [("cold", i, 0.0) for i in range(5)] + [(None, 1, 0.0)] * 2 + [("one", 9, 1.0)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    got = [tuple(r) for r in stats.pairs(df, ["g"], ["k", "x"], block).select("g", "k_a", "x_a", "k_b", "x_b").collect()]
    want = [(g, a, x, b, y) for g in ("hot", "cold", "one") for h, a, x in rows if h == g for i, b, y in rows if i == g]
    assert sorted(got) == sorted(want)
    # no key of the join holds more than two blocks' rows: a block may stray from its mean
    if block == 100:
        plan = stats.pairs(df, ["g"], ["k", "x"], block)._jdf.queryExecution().optimizedPlan().toString()
        assert "__lo" in plan and "__hi" in plan
