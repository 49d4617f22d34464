"""What the corpus operators share: the shared folder, ranks without a hot task, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one ranking bucket should hold, so that a window never sorts an unbounded group. Of n rows, n / BUCKET_ROWS
#: buckets are counted; beyond BUCKET_ROWS ** 2 rows both grow as the square root of n.
BUCKET_ROWS = 512


#: Rows and bytes of one Arrow batch, at most: documents may be long, and a task holds a batch or two.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


_SHIPPED: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches, and once for each application gives the workers this package, which on their
    machines, or from another working folder, they may not find."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        top = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp()
        path = f"{folder}/{top.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        sc.addPyFile(path)
        atexit.register(shutil.rmtree, folder, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A worker's function that hands freed memory back to the system at its end: workers outlive their tasks, and many
    of them share an executor's memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session, as in tests,
    takes a temporary one; on a cluster, whose executors would not see that, it is an error."""
    small_batches(spark)
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder, so that neither a lost executor nor a second reader repeats the work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done: it does so when the driver's garbage collector finds them
    without an owner, which in a driver with little to do may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def text_key(text) -> list:
    """Two independent 64-bit hashes of a text, null as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def unused(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in any case."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, bucket_rows: int = BUCKET_ROWS, copies: int = 1 << 16) -> DataFrame:
    """Adds ``out``: each row's rank from 0 in its group, ordered by the first of ``order`` (a long, spread over its whole
    range like a hash) and then by the rest.

    A group may hold any share of the rows: it is cut into ranges of the first order column, the ranges are counted
    (one small row each), and only ranges are sorted. Equal rows are counted first and take consecutive ranks; where one
    is repeated over ``copies`` times, several tasks write its copies out again.
    """
    names = df.columns
    n, b, at, begin, before, chunk = unused([*names, out], "n", "b", "at", "begin", "before", "chunk")
    df = cut(df.groupBy(*names).agg(F.count(F.lit(1)).alias(n)))
    total, most = df.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(1))).first()
    bucket_rows = max(bucket_rows, int(total**0.5))
    bits = max(0, min(40, int(np.ceil(np.log2(max(1, total / bucket_rows))))))
    # signed order: the arithmetic shift keeps it
    df = df.withColumn(b, F.shiftright(F.col(order[0]), 64 - bits) if bits else F.lit(0).cast("long"))
    part = [*group, b]
    # the groups' ranges: total / bucket_rows of them a group at most
    sizes = df.groupBy(*part).agg(F.sum(n).alias(before))
    ranges = Window.partitionBy(*group).orderBy(F.col(b).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(at, F.coalesce(F.sum(before).over(ranges), F.lit(0)))
    ends = unused([*df.columns, out, before, at], *(f"o{i}" for i in range(len(part))))
    offsets = offsets.select(*[F.col(c).alias(o) for c, o in zip(part, ends)], at)
    on = F.lit(True)
    for c, o in zip(part, ends):
        on = on & F.col(c).eqNullSafe(F.col(o))
    rows = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = df.withColumn(before, F.coalesce(F.sum(n).over(rows), F.lit(0))).join(offsets, on)
    found = found.select(*names, n, (F.col(at) + F.col(before)).cast("long").alias(begin))
    if most == 1:
        return found.select(*names, F.col(begin).alias(out))
    if most > copies:
        found = found.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(copies).cast("long")))).repartition(begin, chunk)
        found = found.select(*names, F.least(F.col(n) - F.col(chunk), F.lit(copies)).alias(n), (F.col(begin) + F.col(chunk)).alias(begin))
    return found.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))).select(*names, (F.col(begin) + F.col(chunk)).alias(out))


def chunked(rows: DataFrame, head: list[str], tie: str, most: int) -> DataFrame:
    """Adds ``chunk``: rows of one ``head`` and chunk are a task's, and any two rows of one head meet in some chunk. A head
    of up to ``most`` rows is one chunk, 0. A larger one is cut into parts of about ``most`` rows by the hash of ``tie``,
    and each pair of parts is a chunk, so that its rows come as often as it has parts."""
    hot = rows.groupBy(*head).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = cut(hot.select(*head, F.ceil(F.col("n") / most).cast("long").alias("parts")))
    if hot.isEmpty():
        return rows.withColumn("chunk", F.lit(0).cast("long"))
    names = rows.columns
    rows = rows.join(hot, head, "left").withColumn("own", F.pmod(F.xxhash64(tie), F.coalesce("parts", F.lit(1))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    return rows.select(*names, F.when(F.col("parts").isNull(), 0).otherwise(F.xxhash64(F.least("own", "other"), F.greatest("own", "other"))).alias("chunk"))


#: Links that one task joins, at most: 16 bytes each, and some arrays of their ends.
TASK_LINKS = 1_000_000


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """Connected components of (src, dst) longs: one row (node, component) for each node, component its smallest node.

    While there are more links than a task takes: large-star and small-star rounds, until nothing changes; each
    aggregates a node's neighbours to their minimum, so that a hub is never gathered in one task. Up to ``task_links``
    are joined in one task, to the same result. No edges give no rows; null ends are left out.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    if e.count() <= task_links:
        return cut(e.repartition(1).mapInArrow(tidy(_joined), "node long, component long"))
    last = None
    while True:
        both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        e = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        least = e.groupBy("src").agg(F.min("dst").alias("m"))
        e = e.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionAll(least.select("src", F.col("m").alias("dst"))).distinct()
        e = cut(e)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        last = now


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    src, dst = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.r_[src, dst], return_inverse=True)
    found = nodes[spanning(len(nodes), at[: len(src)], at[len(src) :])]
    for a in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + (1 << 16)]), pa.array(found[a : a + (1 << 16)])], ["node", "component"])


def spanning(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels (the smallest index of each component) of n nodes after the links i-j."""
    lab = np.arange(n) if labels is None else labels
    while True:
        a, b = lab[i], lab[j]
        m = np.minimum(a, b)
        if (a == b).all():
            return lab
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
