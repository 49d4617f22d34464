"""Line deduplication over levelled, sorted runs of line hashes.

A run is a table (k1, k2, n), bucketed and sorted by the 128-bit key of a line, whose files are in the shared folder; n
is the number of documents of its batches that hold the line. A new batch adds one run at level 0; two runs of a level
are merged into one of the next, so that n batches leave at most log2(n) + 1 runs. All runs have the same buckets: they
are merged, and a batch is held against them, without moving a row of them; only the batch's own keys are shuffled.
Nothing is gathered on the driver.

A table is taken as several batches by ranges of doc_id: each is merge-anti-joined with the runs of those before it, which
tells lines that are new from lines seen before, and then adds its own run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, drop_path, scratch, tidy

#: Batches that a table without a store is taken as.
BATCHES = 4
#: Rows of a run that one bucket should hold; runs are dealt into more buckets once they hold more.
BUCKET_ROWS = 2_000_000

LINES = "doc_id long, t1 long, t2 long, pos int, k1 long, k2 long, first boolean"


def explode_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """One row for each \\n-split line whose key has at least ``min_chars`` code points.

    Key: the line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; k1 and k2 are the halves of its XXH3-128.
    t1 and t2 hash the whole text and, with doc_id, name the row; first: the key's first line in its document.
    Null and empty texts are one empty line, which has no key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                row, pos, firsts, keys, texts = [], [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    texts.append(xxhash.xxh3_128_digest(raw))
                    seen = set()
                    for p, line in enumerate(raw.lower().split(b"\n")):
                        line = line.strip()
                        if not line or min_chars > 1 and len(line.decode("utf-8", "surrogatepass")) < min_chars:
                            continue
                        row.append(i)
                        pos.append(p)
                        firsts.append(line not in seen)
                        seen.add(line)
                        keys.append(xxhash.xxh3_128_digest(line))
                if not keys:
                    continue
                k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                t = np.frombuffer(b"".join(texts), np.int64).reshape(-1, 2)[row]
                col = lambda x, kind: pa.array(np.ascontiguousarray(x), kind)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), col(t[:, 0], pa.int64()), col(t[:, 1], pa.int64()), col(np.array(pos, np.int32), pa.int32()), col(k[:, 0], pa.int64()), col(k[:, 1], pa.int64()), pa.array(firsts)],
                    ["doc_id", "t1", "t2", "pos", "k1", "k2", "first"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), LINES)


class LineRuns:
    """The store: a level holds a bucketed, sorted run or none; two runs of a level become one of the next. ``buckets`` is by
    default the session's number of shuffle partitions; once a run has over ``bucket_rows`` a bucket, all are dealt into
    four times as many, which moves a row as often as the logarithm of the store's size."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.levels, self.bucket_rows = spark, scratch(spark, "line-runs"), [], bucket_rows
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, counts: DataFrame) -> str:
        """A run of (k1, k2, n), each key once; its table's name."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = counts.repartition(self.buckets, "k1", "k2").sortWithinPartitions("k1", "k2")
        dealt.write.format("parquet").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for x in self.levels if x]

    @staticmethod
    def count(lines: DataFrame) -> DataFrame:
        return lines.where("first").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))

    def add(self, name: str) -> None:
        """Takes a run in, and merges levels that hold two."""
        for level, old in enumerate(self.levels):
            if old is None:
                self.levels[level] = name
                break
            merged = self.write(_merged(self.spark.table(old), self.spark.table(name)))
            self._drop(old)
            self._drop(name)
            self.levels[level], name = None, merged
        else:
            self.levels.append(name)
        if self.spark.table(name).count() > self.buckets * self.bucket_rows:  # told by the files' footers
            self.buckets *= 4
            for level, old in enumerate(self.levels):
                if old is not None:
                    self.levels[level] = self.write(self.spark.table(old))
                    self._drop(old)

    def counts(self) -> DataFrame:
        """(k1, k2, n): every key with the number of documents that hold it."""
        return reduce(_merged, self.runs()) if self.runs() else self.spark.createDataFrame([], "k1 long, k2 long, n long")

    def totals(self, name: str) -> DataFrame:
        """(k1, k2, n): the keys of a run that isn't in the store yet, counted there too: it is merged with one run after
        the other, none of whose rows moves."""
        found = self.spark.table(name)
        for run in self.runs():
            more = run.withColumnRenamed("n", "m").hint("merge")
            found = found.join(more, ["k1", "k2"], "left").select("k1", "k2", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        return found

    def seen(self, name: str) -> DataFrame:
        """(k1, k2): the keys of a run that isn't in the store yet that a run of the store holds. The run is merge-anti-joined
        with the store's, which leaves its new keys, and those with itself: no row of any run moves."""
        own = new = self.spark.table(name).select("k1", "k2")
        for run in self.runs():
            new = new.join(run.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        return own.join(new.hint("merge"), ["k1", "k2"], "left_anti")

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines whose key is in no run. The batch's distinct keys merge-anti-join the runs, so that a line of many
        documents goes there once; what is new is then looked up among the lines."""
        keys = lines.select("k1", "k2").distinct().repartition(self.buckets, "k1", "k2")
        for run in self.runs():
            keys = keys.join(run.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        return lines.join(keys, ["k1", "k2"], "left_semi")

    def close(self) -> None:
        """Drops all runs."""
        for name in filter(None, self.levels):
            self._drop(name)
        self.levels = []


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one: where both have the same buckets, a merge join of each bucket with its like. (A union grouped by
    key isn't taken: without the exchange that it may leave out, adaptive execution reads the buckets apart.)"""
    both = a.join(b.withColumnRenamed("n", "m").hint("merge"), ["k1", "k2"], "full")
    return both.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def first_seen(store: LineRuns, docs: DataFrame) -> DataFrame:
    """For batches that arrive one by one: (doc_id, t1, t2, pos, k1, k2) of this batch's lines that no earlier batch held,
    after which they join the runs. Lines of this batch are not held against each other; repeated rows come as often as
    they do; null and empty texts have no line, and an empty batch gives none."""
    lines = explode_lines(docs)
    kept = cut(store.unseen(lines).select("doc_id", "t1", "t2", "pos", "k1", "k2"))
    store.add(store.write(store.count(lines)))
    return kept


def batch_of(docs: DataFrame, doc_id: str = "doc_id", batches: int = BATCHES) -> Column:
    """The batch of a row: doc_ids from the least to the largest in so many ranges of one width; null goes with the first."""
    least, most = docs.agg(F.min(F.col(doc_id).cast("long")), F.max(F.col(doc_id).cast("long"))).first()
    if least is None or batches == 1:
        return F.lit(0)
    return F.coalesce(F.expr(f"cast((cast(cast(`{doc_id}` as long) as decimal(20, 0)) - {least}) div {(most - least) // batches + 1} as int)"), F.lit(0))


def drop_frequent(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id", store: LineRuns | None = None, batches: int | None = None, tell_seen: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document without the lines whose key at least ``min_docs`` documents
    hold, among these and all batches that ``store`` took before. tell_seen adds n_seen: its lines whose key a batch before
    its own held.

    docs join ``store`` as one batch; without a store they are taken in BATCHES of them. ``batches`` says otherwise: so many
    ranges of doc_id (see ``batch_of``), each of which is held against the runs before it adds its own. Every row counts as a document, repeated rows too. Null and empty texts are one empty line, which stays;
    very long texts are taken whole. Lines that stay are joined by \\n as they were; if none stays the text is empty. An
    empty table gives no rows.
    """
    spark, own = docs.sparkSession, store is None
    batches = batches or (BATCHES if own else 1)
    path = scratch(spark, "lines")
    explode_lines(docs, text, doc_id, min_chars).withColumn("batch", batch_of(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", batches)).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"{LINES}, batch int").parquet(path)
    if own:
        store = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // BUCKET_ROWS))
    seen = None
    try:
        for b in range(batches):
            run = store.write(store.count(lines.where(F.col("batch") == b)))
            if tell_seen and store.runs():
                old = cut(store.seen(run).withColumn("batch", F.lit(b)))
                seen = old if seen is None else seen.unionAll(old)
            store.add(run)
        # written, so that its size is known: the join broadcasts it if small, and else splits the commonest lines
        often = cut(store.counts().where(F.col("n") >= min_docs).select("k1", "k2"))
    finally:
        if own:
            store.close()
    hits = lines.join(often, ["k1", "k2"]).select("doc_id", "t1", "t2", F.col("pos").alias("gone"), F.lit(None).cast("int").alias("seen"))
    if seen is not None:
        hits = hits.unionAll(lines.join(seen, ["k1", "k2", "batch"]).select("doc_id", "t1", "t2", F.lit(None).cast("int"), "pos"))
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2")).agg(F.collect_set("gone").alias("gone"), F.size(F.collect_set("seen")).alias("n_seen"))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.mapInArrow(tidy(_keyed), "doc_id long, text string, t1 long, t2 long")
    both = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    found = both.select("doc_id", "text", "gone", F.coalesce("n_seen", F.lit(0)).cast("long").alias("n_seen")).mapInArrow(tidy(_without), "doc_id long, text string, n_lines long, n_dropped long, n_seen long")
    return found if tell_seen else found.drop("n_seen")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, sizes, dropped = [], [], []
        for t, gone in zip(b.column(1), b.column(2).to_pylist()):
            t, gone = t.as_py(), set(gone or ())
            sizes.append(t.count("\n") + 1)
            dropped.append(len(gone))
            texts.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), b.column(3)], ["doc_id", "text", "n_lines", "n_dropped", "n_seen"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = np.frombuffer(b"".join(xxhash.xxh3_128_digest((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in b.column(1)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.ascontiguousarray(t[:, 0])), pa.array(np.ascontiguousarray(t[:, 1]))], ["doc_id", "text", "t1", "t2"])
