"""Incremental builds: a table partitioned by day is rebuilt only where its source moved.

The source's fingerprints by day (rows and an order-independent checksum) are kept beside the table, and are its change
feed: days that are new, changed or gone. Only their rows are read again, built, and written over by dynamic partition
overwrite; all other files stay as they are. Fingerprints are written last, so that a build that broke off is taken up
where it was: what it wrote is written again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.audit import fingerprint_diff, fingerprints
from quern.operators.stats import same
from quern.sources.shared import cut


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _states(spark: SparkSession, path: str) -> list[int]:
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n[6:]) for n in names if n.startswith("state-") and fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[0]))


def _drop(spark: SparkSession, path: str) -> None:
    where, fs = _files(spark, path)
    fs.delete(where, True)


def table(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was last built."""
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")


def rebuild(source: DataFrame, path: str, day: str, build: Callable[[DataFrame], DataFrame], version: str = "", columns: Sequence[str] | None = None) -> DataFrame:
    """(day, rows_before, rows_now, verdict): brings the table at ``path`` up to source, and says which days had moved; none:
    nothing is written.

    build maps rows of source to the table's, each day by itself, and keeps ``day``. columns: those that the table depends
    on (all). Another ``version`` than the last build's, which stands for the build's definition, moves every day. A null
    day is a day. The days that moved are gathered on the driver: a row each.
    """
    spark = source.sparkSession
    states = _states(spark, path)
    now = cut(fingerprints(source, [day], list(columns or source.columns)).withColumn("version", F.lit(version)))
    before = spark.read.parquet(f"{path}/state-{states[-1]}") if states else now.limit(0)  # total: no row is taken
    before = before.withColumn("checksum", F.when(F.col("version") == version, F.col("checksum")))  # null is like no checksum
    marked = lambda df: df.select(F.coalesce(F.col(day).cast("string"), F.lit("__null")).alias("__day"), "rows", "checksum")
    days = now.select(day).unionByName(before.select(day)).distinct().withColumn("__day", F.coalesce(F.col(day).cast("string"), F.lit("__null")))
    diff = fingerprint_diff(marked(before), marked(now), ["__day"]).where("verdict <> 'identical'")
    moved = cut(diff.join(days, "__day").select(day, "__day", F.col("rows_a").alias("rows_before"), F.col("rows_b").alias("rows_now"), "verdict"))
    found = moved.collect()
    if found:
        rows = same(source, moved.where("rows_now is not null").select(day), [day], "left_semi")
        made = cut(build(rows))
        have = {r[0] for r in made.select(F.coalesce(F.col(day).cast("string"), F.lit("__null"))).distinct().collect()}
        if have:
            made.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{path}/data")  # total: the writer mode, not a statistic
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for r in found:  # days that are gone, or of which nothing is left
            if r["__day"] not in have:
                _drop(spark, f"{path}/data/{escape(day, None if r[day] is None else r['__day'])}")
        n = states[-1] + 1 if states else 0
        now.repartition(1).write.mode("overwrite").parquet(f"{path}/state-{n}")  # total: the writer mode, not a statistic
        for old in states:
            _drop(spark, f"{path}/state-{old}")
    return moved.drop("__day")
