import random

from quern.operators import stats


def test_larger_numbers_of_a_group_without_its_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-9, 60)])) for _ in range(400)] + [("alone", 7)]
    got = {(r.g, r.k): (r.n, r.more, r.total) for r in stats.above(spark.createDataFrame(rows, "g string, k long"), ["g"], "k", partitions=9).collect()}
    known = [(g, k) for g, k in rows if g is not None and k is not None]
    larger = lambda g, k: [x for h, x in known if h == g and x > k]
    assert got == {(g, k): (known.count((g, k)), len(larger(g, k)), sum(larger(g, k))) for g, k in known}


def test_the_hot_groups_pairs_are_not_made(spark, tmp_path):
    from quern.plans.registry import queries

    spark.range(100_000).selectExpr("id * 5 as p_partkey", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")  # five billion pairs
    n = 100_000
    assert sum(r.n for r in queries()["rl26_pairs_of_a_hot_group"](spark, str(tmp_path)).collect()) == n * (n - 1) // 2
