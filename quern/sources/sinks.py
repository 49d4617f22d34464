"""Sinks: JSON arrays and objects in one deterministic file, Parquet, CSV, models with a row-count proof."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import cut, ship


def json_lines(df: DataFrame):
    """Each row as JSON, nulls written out, in the order of df; partitions come to the driver one at a time."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    return (r.j for r in rows.toLocalIterator(prefetchPartitions=True))


def write_json_array(df: DataFrame, path: str) -> int:
    """An ordered table as one JSON array, byte for byte the same from run to run; returns its rows. For publications,
    whose readers want one file; use Spark's own writer for anything larger."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for line in json_lines(df):
            f.write((",\n\t" if n else "\n\t") + line)
            n += 1
        f.write("\n]\n")
    return n


def write_json_array_in_tasks(df: DataFrame, path: str) -> int:
    """``write_json_array``'s file, byte for byte, written by tasks: the table's lines are written once in its order, a
    task's bytes are counted, and each task writes its own at its place in the one file, whose folder must be mounted on all
    machines. Only a count for each task reaches the driver."""
    ship(df.sparkSession)
    lines = cut(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"), F.spark_partition_id().alias("p")))
    sizes = lines.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("j") + 3).alias("bytes")).orderBy("p").collect()  # two numbers a task; each line has two or three bytes of its own
    begin, at = {}, 1
    for i, r in enumerate(sizes):
        begin[r.p], at = (at, i == 0), at + r.bytes - (i == 0)
    with open(path, "wb") as f:
        f.write(b"[")
        f.seek(at)
        f.write(b"\n]\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, n = None, 0
        for b in batches:
            for p, j in zip(b.column("p").to_pylist(), b.column("j").to_pylist()):
                if f is None:
                    f = open(path, "r+b")  # noqa: SIM115
                    f.seek(begin[p][0])
                f.write((("" if begin[p][1] and not n else ",") + "\n\t" + j).encode())
                n += 1
        if f is not None:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return lines.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # total: an aggregate is one row


def write_json_object(df: DataFrame, path: str) -> None:
    rows = list(json_lines(df.limit(2)))  # total: any two rows will do: they are counted
    if len(rows) != 1:
        raise ValueError(f"a JSON object needs exactly one row, there are {len(rows)} or more")
    with open(path, "w", encoding="utf-8") as f:
        f.write(rows[0] + "\n")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")  # total: the writer mode, not a statistic
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)  # total: the writer mode, not a statistic


def write_model(df: DataFrame, path: str, rows_in: int | None = None, partition_by: list[str] | None = None) -> int:
    """Writes a model and proves that no row was lost or made on the way."""
    write_parquet(df, path, partition_by)
    n = df.sparkSession.read.parquet(path).count()
    if rows_in is not None and n != rows_in:
        raise ValueError(f"{path}: {n} rows out of {rows_in}")
    return n


def compact(df: DataFrame, path: str, files: int) -> int:
    """Rewrites a table into fewer files, with the row-count proof."""
    return write_model(df.coalesce(files), path, df.count())


def build_stamp(built_utc: str, sources: dict[str, str]) -> dict[str, str]:
    """What a build was made from: its time and the SHA-256 of each source text."""
    return {"built_utc": built_utc} | {f"{k}.sha256": hashlib.sha256(v.encode()).hexdigest() for k, v in sorted(sources.items())}


def canonical(document) -> str:
    return json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
