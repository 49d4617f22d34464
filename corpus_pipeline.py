"""The corpus pipeline: documents through five operators, each of which works on all that its predecessor kept.

Toxic documents go, one document of each class of near duplicates stays, documents that hold a benchmark passage go,
the rest is put into the order of the mixture, and the shards' slots follow that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, near_text, sharding, toxicity
from quern.llm.common import scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches their language's threshold (a tie goes). Null and empty texts score alike and
    stay; null languages go by all; very long texts are read whole; repeated rows are judged one by one."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: five-word shingles, similarity 0.8. The smallest doc_id stays, null last, ties by the
    text's hash; rows repeated whole stay once; texts without a word (null and empty alike) are of the class of equal
    ones; very long texts are taken whole."""
    return near_text.keep_one(docs, k=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item within its edit budget (at it, too). Null and empty texts stay; very
    long ones are searched whole; repeated rows are judged one by one; an empty benchmark takes none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, sorted into the mixture's order: a null source is a source, equal rows take a place each, and rows of one
    hash go by doc_id and text's hash; null, empty and very long texts are rows like others."""
    return mixing.reorder(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, mix_position, shard, slot): slots follow the mixture, so that each shard is mixed too.

    The mixture's positions follow from the rows alone, so that they are the same here as in the stage before, in
    whatever order the files are read."""
    placed = sharding.shard(docs, positions=mixing.mix(docs))
    return placed.select("doc_id", "size", "text_crc32", F.col("position").alias("mix_position"), "shard", "slot")


STAGES = [("toxicity", toxic), ("simhash near duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: A trained network decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
