"""Readers: SQLite archives, filtered loads, stable row numbers, JSON arrays, whole files, provenance, Parquet footers."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.sources.shared import ship

_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}


def sqlite_query(path: str, query: str, params: tuple = ()) -> list[tuple]:
    """Passes a query through to a read-only SQLite file; for small results such as its catalogue."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return db.execute(query, params).fetchall()


def sqlite_to_parquet(path: str, table: str, out: str, schema: T.StructType, rows: int = 200_000) -> int:
    """Copies a SQLite table to one Parquet file in blocks; returns its rows. SQLite is one file on one machine, so the
    copy is too; everything after it reads the Parquet file."""
    kinds = pa.schema([(f.name, _ARROW[f.dataType]) for f in schema.fields])
    n = 0
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db, pq.ParquetWriter(out, kinds, compression="zstd") as to:
        found = db.execute(f'SELECT {", ".join(chr(34) + f.name + chr(34) for f in schema.fields)} FROM "{table}"')
        while block := found.fetchmany(rows):
            to.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*block), kinds.types)], schema=kinds))
            n += len(block)
    return n


def filtered_load(prices: DataFrame, products: DataFrame, vendors: list[str]) -> tuple[DataFrame, DataFrame]:
    """The vendors' products, and the prices that are theirs: a semi-join, so that nothing else is shuffled on."""
    some = products.where(F.col("vendor").isin(*vendors))
    return prices.join(some.select(F.col("id").alias("product_id")).distinct(), "product_id", "left_semi"), some


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)  # total: no row is taken


def with_row_ids(df: DataFrame, name: str = "src_rowid") -> DataFrame:
    """Numbers the rows of a Parquet table by file and place in it, gaplessly from 0: the same number at every reading.

    Only one count a file is sorted on one task.
    """
    from pyspark.sql import Window

    rows = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i"))
    files = rows.groupBy("__f").agg(F.count(F.lit(1)).alias("__n"))
    begin = F.coalesce(F.sum("__n").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files.select("__f", begin.alias("__b")), "__f").withColumn(name, F.col("__b") + F.col("__i")).drop("__f", "__i", "__b")


def provenance(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), "k string, v string")


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, md5) of each file, as text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.length("value").cast("long").alias("bytes"), F.md5(F.col("value").cast("binary")).alias("md5"))


def parquet_bytes(spark: SparkSession, path: str) -> int:
    """Compressed bytes of the column chunks of a Parquet file, or of all those in a folder and its partitions, from their
    footers alone; wherever Spark can read them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    found, total = where.getFileSystem(conf).listFiles(where, True), 0
    while found.hasNext():
        at = found.next().getPath()
        if at.getName().endswith(".parquet"):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
            total += sum(block.getCompressedSize() for block in reader.getFooter().getBlocks())
            reader.close()
    return total


FOOTERS = "file string, row_group int, column_name string, rows long, compressed long, uncompressed long, nulls long, low string, high string"


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, column_name, rows, compressed, uncompressed, nulls, low, high): one row for each column chunk of the
    Parquet files under a path, by their footers, which tasks read; nulls, low and high (as text) are null where a writer
    kept no statistics. Spark lists the files; their footers are opened by Arrow, which knows local, HDFS, S3 and GCS paths.
    """
    ship(spark)
    kinds = to_arrow_schema(T.StructType.fromDDL(FOOTERS))
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")  # no content is read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file in b.column(0).to_pylist():
                local = re.match("file:(?://)?(/.*)", file)
                system, at = (pa.fs.LocalFileSystem(), local[1]) if local else pa.fs.FileSystem.from_uri(file)
                with system.open_input_file(at) as f:
                    meta = pq.read_metadata(f)
                for g in range(meta.num_row_groups):
                    for i in range(meta.num_columns):
                        c = meta.row_group(g).column(i)
                        s = c.statistics if c.is_stats_set else None
                        bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                        out.append((file, g, c.path_in_schema, c.num_values, c.total_compressed_size, c.total_uncompressed_size, s.null_count if s is not None and s.has_null_count else None, *bounds))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds.types)], schema=kinds)

    return named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, FOOTERS)


def attach(spark: SparkSession, database: str, folder: str) -> list[str]:
    """Every Parquet table of a folder (a file or folder NAME.parquet) as the table NAME of a database, so that one query
    may read several snapshots: SELECT ... FROM today.part JOIN before.part. The names of the tables; those of an earlier
    attachment under the same name go."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))
    names = [n.removesuffix(".parquet") for n in names if n.endswith(".parquet")]
    detach(spark, database)
    spark.sql(f"CREATE DATABASE `{database}`")
    for n in names:
        spark.sql(f"CREATE TABLE `{database}`.`{n}` USING parquet OPTIONS (path '{folder}/{n}.parquet')")
    return names


def detach(spark: SparkSession, database: str) -> None:
    """Forgets an attached database; its files stay."""
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")


def catalogue(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, column_name, position, data_type) of every column of a database's tables, positions from 1."""
    rows = [(t.name, c.name, i, c.dataType) for t in spark.catalog.listTables(database) if not t.isTemporary for i, c in enumerate(spark.catalog.listColumns(f"`{database}`.`{t.name}`"), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string")


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row (d) for each day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d"))


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A call's own few rows, which a join takes to the other side: dealt out by their few keys, that would be a few tasks'."""
    return F.broadcast(spark.createDataFrame(rows, schema))
