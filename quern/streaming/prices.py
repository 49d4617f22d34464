"""The price model over a stream of price files: stateless parsing, a stream-static join with the products, and row
counts by day that late files still reach. An extension: batch builds are the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.plans.models import stg_price
from quern.sources.schema import PRICES


def read(spark: SparkSession, folder: str, version: int = 2, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with a row number made of file and place: 64 bits of a hash,
    so that two rows of a billion share one with a chance of some 3 %; a table that must be unique is keyed by both."""
    rows = spark.readStream.schema(PRICES[version]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("src_rowid", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def parsed(stream: DataFrame, products: DataFrame, version: int = 2) -> DataFrame:
    """stg_price of a stream; products are static and counted once, so that a small table is broadcast."""
    return stg_price(stream, products, version)


def daily_counts(prices: DataFrame, lateness: str = "3 days") -> DataFrame:
    """(day window, offer_type, rows, priced) of a parsed stream; days stay open for late files until ``lateness`` has passed."""
    timed = prices.where("observed_date is not null").withColumn("at", F.col("observed_date").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 day").alias("day"), "offer_type").agg(F.count(F.lit(1)).alias("rows"), F.count("unit_price").alias("priced"))


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet exactly once, from a checkpoint; ends when what has arrived is done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
