"""Spells of a stream against the batch operator, whatever the order the rows come in."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.operators import timeline
from quern.streaming import spells as S

KEYS = ["g", "v"]
SCHEMA = "g long, v string, d date, px double, on_sale int"
DAY = dt.date(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    old = spark.conf.get(S.PROVIDER[0], None)
    S.with_state(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield
    spark.conf.unset(S.PROVIDER[0]) if old is None else spark.conf.set(S.PROVIDER[0], old)


def draw(rng, series=12, days=60):
    rows = []
    for g in range(series):
        px = 1.0
        for n in range(days):
            if rng.random() < 0.2:
                px = rng.choice([1.0, 2.0, 2.004, 3.0])
            if rng.random() < 0.7:
                rows += [(g, "a" if g % 2 else "b", DAY + dt.timedelta(n), px + rng.choice([0, 0, 1]), rng.choice([0, 0, 0, 1]))] * rng.choice([1, 1, 2])
    return rows


END = (-1, "end", DAY + dt.timedelta(2000), 1.0, 0)


def run(spark, tmp_path, batches, lateness):
    path = tmp_path / "in"
    path.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    q = S.write(S.spells(stream, KEYS, lateness), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert q.awaitTermination(240)
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("g >= 0").select(*KEYS, "from_date", "to_date", "px", "observed_days", "on_sale", "calendar_days").collect())), q


def batch(spark, rows):
    e = spark.createDataFrame(rows, SCHEMA).withColumn("sale", F.col("on_sale") > 0)
    found = timeline.spells(timeline.daily(e, KEYS, "d", "px", "sale"), KEYS)
    return sorted(map(tuple, found.select(*KEYS, "from_date", "to_date", "px", "observed_days", "on_sale", "calendar_days").collect()))


def test_rows_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = draw(rng)
    rng.shuffle(rows)
    got, _ = run(spark, tmp_path, [rows[i::4] for i in range(4)] + [[END]], "100 days")
    assert got == batch(spark, rows) and len(got) > 100


def test_days_in_order_leave_the_state(spark, tmp_path):
    rows = sorted(draw(random.Random(5), series=6), key=lambda r: r[2])
    parts = [[r for r in rows if (r[2] - DAY).days // 12 == i] for i in range(5)]
    for p in parts:
        random.Random(1).shuffle(p)
    got, q = run(spark, tmp_path, [*parts, [END]], "0 days")
    # with no lateness a batch's own days are still open when the next begins
    assert got == batch(spark, rows)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert sizes[-1] < max(sizes) < len(rows)


def test_too_late_rows_are_left_out(spark, tmp_path):
    rows = [(1, "a", DAY + dt.timedelta(n), 1.0, 0) for n in (0, 1, 2)]
    late = [(1, "a", DAY + dt.timedelta(1), 9.0, 0)]
    far = [(2, "a", DAY + dt.timedelta(50), 1.0, 0)]
    got, _ = run(spark, tmp_path, [rows, far, late, [END]], "10 days")
    assert got == batch(spark, rows + far)


def test_the_state_is_asked_by_series_not_by_row():
    class State:
        def __init__(self):
            self.calls, self.held = 0, None

        def _called(self, held):
            self.calls += 1
            self.held = held

        def get(self):
            self.calls += 1
            return iter(self.held or ()) if self.many else self.held

        put = update = _called

        def clear(self):
            self._called(None)

        registerTimer = _called  # noqa: N815

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.held

    handle, now = State(), State()
    days, open_ = State(), State()
    days.many, open_.many = True, False
    handle.getListState, handle.getValueState = (lambda *_: days), (lambda *_: open_)
    s = S.Spells(KEYS, 3, 0.005)
    s.init(handle)
    now.held = -1
    rows = [Row(d=DAY + dt.timedelta(n % 40), px=1.0 + (n % 40 >= 20), on_sale=0) for n in range(4_000)]
    assert list(s.handleInputRows((1, "a"), iter(rows), now)) == []
    now.held = S._ms(DAY) + 2000 * S._DAY_MS
    got = list(s.handleExpiredTimer((1, "a"), now, None))
    assert [(r.px, r.observed_days, r.calendar_days) for r in got] == [(1.0, 20, 20), (2.0, 20, 20)]
    assert days.held is None and open_.held is None and days.calls + open_.calls + handle.calls < 12
