import random

from quern.operators import stats


def test_later_rounds_read_what_is_inside_alone(spark):
    rng = random.Random(5)
    values = {g: sorted(round(rng.gauss(0, 50), 2) for _ in range(9000)) for g in ("a", None)}
    rows = spark.createDataFrame([(g, v) for g, x in values.items() for v in x], "g string, v double")
    ranks = (0, 17, 4499, 4500, 8999)
    targets = spark.createDataFrame([(g, k, 9000) for g in values for k in ranks], "g string, k long, n long")
    state, left = stats._narrowed(rows, ["g"], targets, 50)
    assert left.count() < 1000 and left.count() >= 0
    assert {(r.g, r.k): r.v for r in stats.selected(rows, ["g"], targets, 50).collect()} == {(g, k): x[k] for g, x in values.items() for k in ranks}
    # brackets that overlap keep a row once
    two = spark.createDataFrame([("a", -10.0, 5.0), ("a", 0.0, None)], "g string, lo double, hi double")
    assert stats.within(rows, ["g"], two).count() == sum(v > -10 for v in values["a"])
