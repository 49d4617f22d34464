"""SQLite archives as a data source, footers read by tasks, and a JSON array written by tasks."""

import json
import sqlite3

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.sources import readers, sinks, sqlite


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    sqlite.register(spark)
    path = f"{tmp_path_factory.mktemp('a')}/one.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "t ""x" (id INTEGER, name VARCHAR(9), price REAL, raw BLOB, "any" DATE)')
        db.executemany('INSERT INTO "t ""x" VALUES (?,?,?,?,?)', [(i, None if i % 7 == 0 else f"n{i % 50}", i / 4, bytes([i % 256]), "2024-01-01") for i in range(1000)])
        db.execute('INSERT INTO "t ""x" VALUES (\'odd\', 5, \'text\', 3, NULL)')
        db.execute('DELETE FROM "t ""x" WHERE id BETWEEN 300 AND 399')
        db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        db.executemany("INSERT INTO keyed VALUES (?,?)", [(f"k{i}", i) for i in range(20)])
        db.execute("CREATE TABLE empty (k TEXT)")
    return path


def read(spark, path, table='t "x', partitions=10, push=False):
    return spark.read.format("sqlite").option("table", table).option("partitions", partitions).option("push", push).load(path)


def test_ranges_of_rowids_are_the_table(spark, archive):
    df = read(spark, archive)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ("raw", "binary"), ("any", "string")] and df.rdd.getNumPartitions() == 10
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 901 and rows[7].name is None and rows[8].price == 2.0 and bytes(rows[9].raw) == b"\t" and (rows[None].name, rows[None].price, rows[None].raw) == ("5", None, None)
    assert read(spark, archive, "keyed").count() == 20 and read(spark, archive, "empty").count() == 0
    assert [r.name for r in spark.read.format("sqlite").option("table", 't "x').schema("name string, id long").load(archive).where("id = 8").collect()] == ["n8"]
    for bad in (lambda: read(spark, archive, "absent"), lambda: read(spark, archive + "x")):
        with pytest.raises(PySparkException):
            bad().collect()


@pytest.mark.parametrize("where", ["id > 990", "id >= 990 and id < 995", "name = 'n3'", "name is null", "name is not null and price <= 3", "id in (1, 2, 350, 999)", "not id in (1, 2)", "name like 'n1%'", "name like '%4%'", "name <=> null", "id <> 5", "price = 2.5 or id = 3", "name > 'n49'", "raw = X'09'"])
def test_filters_keep_what_spark_keeps(spark, archive, where):
    df = read(spark, archive)
    kept = sorted(map(str, spark.createDataFrame(df.collect(), df.schema).where(where).collect()))
    for push in (False, True):
        assert sorted(map(str, read(spark, archive, push=push).where(where).collect())) == kept


def test_filters_reach_sqlite(spark, archive):
    from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

    reader = sqlite.PushingReader(read(spark, archive).schema, {"path": archive, "table": 't "x'})
    asked = [EqualTo(("name",), "n3"), In(("id",), (3, 53, 103)), Not(EqualTo(("id",), 53)), StringStartsWith(("name",), "n")]
    assert list(reader.pushFilters(asked)) == asked and len(reader.where) == 4
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_sink_and_folders(spark, tmp_path):
    sqlite.register(spark)
    df = spark.range(1000).select("id", F.concat(F.lit("'é\""), F.col("id").cast("string")).alias("s"), (F.col("id") % 2 == 0).alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") / 3).alias("d"))
    for n in (4, 3):
        df.repartition(n).write.format("sqlite").mode("overwrite").option("table", "t").save(str(tmp_path / "f"))
        assert len(sqlite.files(str(tmp_path / "f"))) == n and not list((tmp_path / "f").glob("*.part"))
    df.where("id < 10").coalesce(1).write.format("sqlite").mode("append").option("table", "t").save(str(tmp_path / "f"))
    back = spark.read.format("sqlite").option("table", "t").schema(df.schema).load(str(tmp_path / "f"))
    assert back.where("id >= 10").exceptAll(df.where("id >= 10")).count() == 0 and back.count() == 1010
    q = spark.read.format("sqlite").option("query", "SELECT b, count(*) AS n FROM t GROUP BY b").schema("b long, n long").load(str(tmp_path / "f"))
    assert q.count() == 8 and {r.b: r.n for r in q.groupBy("b").agg(F.sum("n").alias("n")).collect()} == {0: 505, 1: 505}


def test_footers_equal_arrows(spark, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), "id")).alias("s"), F.struct(F.col("id").alias("x")).alias("n"), (F.col("id") % 2).alias("p"))
    df.repartition(3).write.partitionBy("p").parquet(str(tmp_path / "with space"))
    got = {(r.file.partition("with space/")[2], r.row_group, r.column_name): r for r in readers.footers(spark, str(tmp_path / "with space")).collect()}
    want = 0
    for f in (tmp_path / "with space").rglob("*.parquet"):
        meta = pq.read_metadata(f)
        for g in range(meta.num_row_groups):
            for i in range(meta.num_columns):
                c, want = meta.row_group(g).column(i), want + 1
                r = got[str(f).partition('with space/')[2], g, c.path_in_schema]
                assert (r.rows, r.compressed, r.uncompressed, r.nulls) == (c.num_values, c.total_compressed_size, c.total_uncompressed_size, c.statistics.null_count)
    assert len(got) == want > 0 and readers.parquet_bytes(spark, str(tmp_path / "with space")) == sum(r.compressed for r in got.values())


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 1), (1000, 1), (1000, 7)])
def test_json_array_by_tasks_is_the_drivers(spark, tmp_path, n, parts):
    df = spark.range(n).select("id", F.concat(F.lit("é\"\n"), F.repeat(F.lit("x"), (F.col("id") % 5).cast("int"))).alias("s"), F.when(F.col("id") % 2 > 0, 1.5).alias("d")).repartitionByRange(parts, F.col("id").desc()).sortWithinPartitions(F.col("id").desc())
    assert sinks.write_json_array(df, f"{tmp_path}/a.json") == sinks.write_json_array_in_tasks(df, f"{tmp_path}/b.json") == n
    assert (tmp_path / "a.json").read_bytes() == (tmp_path / "b.json").read_bytes() and len(json.loads((tmp_path / "b.json").read_text())) == n
