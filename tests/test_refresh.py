"""Incremental builds: the same table as a full one, and no other file touched than those of the days that moved."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quern.plans import refresh

SCHEMA = "d date, k long, px double, note string"
DAYS = [dt.date(2024, 1, n) for n in range(1, 11)]


def rows(change=lambda d, k: k / 4):
    return [(d, k, change(d, k), "x") for d in [*DAYS, None] for k in range(20)]


def build(df):
    return df.where("px >= 0").groupBy("d", (F.col("k") % 5).alias("g")).agg(F.sum("px").alias("px"))


def files(path):
    return {os.path.relpath(os.path.join(at, f), path): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def equal(spark, path, source):
    got, want = refresh.table(spark, path).select("d", "g", "px"), build(source)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_only_what_moved_is_written(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda r: spark.createDataFrame(r, SCHEMA)
    first = make(rows())
    assert {r.verdict for r in refresh.rebuild(first, path, "d", build).collect()} == {"only second"}
    equal(spark, path, first)
    before = files(path)
    assert refresh.rebuild(first.repartition(7), path, "d", build).count() == 0 and files(path) == before
    three = {DAYS[2], DAYS[5], None}
    second = make(rows(lambda d, k: 9.0 if d in three and k == 3 else k / 4))
    found = {r.d: (r.rows_before, r.rows_now, r.verdict) for r in refresh.rebuild(second, path, "d", build).collect()}
    assert found == {d: (20, 20, "content changed") for d in three}
    after = files(path)
    stayed = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[1] for f in before.keys() - stayed} == {"d=2024-01-03", "d=2024-01-06", "d=__HIVE_DEFAULT_PARTITION__"} and len(stayed) > 0
    equal(spark, path, second)
    third = make([r for r in rows() if r[0] not in (DAYS[0], None)] + [(dt.date(2024, 2, 1), 1, 5.0, "new")])
    third = third.withColumn("px", F.when(F.col("d") == F.lit(DAYS[1]), -1.0).otherwise(F.col("px")))  # of that day nothing is built
    verdicts = {r.d: r.verdict for r in refresh.rebuild(third, path, "d", build).collect()}
    assert verdicts == {DAYS[0]: "only first", None: "only first", DAYS[1]: "content changed", DAYS[2]: "content changed", DAYS[5]: "content changed", dt.date(2024, 2, 1): "only second"}
    equal(spark, path, third)


def test_columns_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    source = spark.createDataFrame(rows(), SCHEMA)
    refresh.rebuild(source, path, "d", build, "1", ["d", "k", "px"])
    assert refresh.rebuild(source.withColumn("note", F.lit("other")), path, "d", build, "1", ["d", "k", "px"]).count() == 0
    assert refresh.rebuild(source, path, "d", build, "2", ["d", "k", "px"]).count() == 11
    assert refresh.rebuild(source, path, "d", build, "2", ["d", "k", "px"]).count() == 0


def test_a_build_that_broke_off_is_taken_up(spark, tmp_path):
    path = str(tmp_path / "t")
    source = spark.createDataFrame(rows(), SCHEMA)
    with pytest.raises(Exception, match="raised"):
        refresh.rebuild(source, path, "d", lambda df: build(df).withColumn("px", F.raise_error(F.lit("raised")).cast("double")))
    refresh.rebuild(source, path, "d", build)
    equal(spark, path, source)
    gone = source.limit(0)
    assert {r.verdict for r in refresh.rebuild(gone, path, "d", build).collect()} == {"only first"} and files(path) == {}
