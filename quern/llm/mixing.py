"""Mixing sources to target weights by Pfair scheduling.

A source whose share of the weights is w releases its block j at slot floor(j / w) and must have it placed by slot
ceil((j + 1) / w). One block goes out a slot, of the released blocks the one with the earliest deadline; as the shares
sum to one, no deadline is missed, and after every slot each source is less than one block off its share.

The weights are taken as they are, as exact rationals over the whole run. The driver schedules the blocks that have rows
one after the other, and writes them down in pieces, so that it holds one piece however many there are; workers map the
pieces that their rows are in.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ranked, scratch, text_key, tidy, unused
from quern.llm.kneser_ney import Store
from quern.llm.near_text import KeyFile, row_keys

BLOCK_ROWS = 16
#: Sources that one schedule mixes, at most: the driver holds some numbers of each.
MAX_SOURCES = 100_000
#: Blocks that the driver schedules before it writes them down.
PIECE_BLOCKS = 1 << 19


def earliest_first(weights: list, blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, j, release, deadline, slot) of every block of the sources, by earliest deadline first from the exact
    weights. Sources without blocks, or with no more, leave their slots empty."""
    if weights and min(weights) <= 0:
        raise ValueError("every source needs a weight above 0")
    exact = [Fraction(w) for w in weights]
    total = sum(exact)
    turn = [(total / w).as_integer_ratio() for w in exact]  # slots from one block to the next
    waiting = [(0, i, 0) for i, n in enumerate(blocks) if n]
    ready: list[tuple] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, i, j = heapq.heappop(waiting)
            up, down = turn[i]
            heapq.heappush(ready, (-(-(j + 1) * up // down), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        yield i, j, release, deadline, t
        if j + 1 < blocks[i]:
            up, down = turn[i]
            heapq.heappush(waiting, ((j + 1) * up // down, i, j + 1))
        t += 1


@dataclass
class Plan:
    """Where workers find each block's release, deadline, slot and first position. A piece of the schedule holds some
    consecutive blocks of each source, in the order of the sources: ``key`` is a source and its first block there, and
    ``piece`` and ``at`` say where these begin."""

    names: dict
    targets: np.ndarray
    store: Store
    key: np.ndarray
    piece: np.ndarray
    at: np.ndarray
    block_rows: int

    @staticmethod
    def of(spark: SparkSession, weights: dict, rows: dict, block_rows: int, piece_blocks: int = PIECE_BLOCKS) -> Plan:
        names = sorted(weights, key=lambda s: (s is not None, s or ""))
        count = [rows.get(s, 0) for s in names]
        store = Store(scratch(spark, "mixture"))
        heads: list[list[np.ndarray]] = []
        buffer: list[tuple] = []
        placed = 0

        def flush() -> None:
            nonlocal placed
            x = np.array(buffer, np.int64).T
            size = np.minimum(block_rows, np.array(count, np.int64)[x[0]] - x[1] * block_rows)
            first = placed + np.cumsum(size) - size
            placed += int(size.sum())
            order = np.lexsort((x[1], x[0]))
            store.save(f"piece-{len(heads)}", np.vstack([x[2:], first])[:, order])
            source, j = x[0][order], x[1][order]
            new = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            heads.append([source[new] << 40 | j[new], np.full(len(new), len(heads)), new])
            buffer.clear()

        for block in earliest_first([weights[s] for s in names], [-(-n // block_rows) for n in count]):
            buffer.append(block)
            if len(buffer) >= piece_blocks:
                flush()
        if buffer:
            flush()
        key, piece, at = (np.concatenate([*(h[i] for h in heads), np.zeros(0, np.int64)]).astype(np.int64) for i in range(3))
        order = np.argsort(key)
        total = sum(map(Fraction, weights.values()))
        targets = np.array([float(Fraction(weights[s]) / total) for s in names])
        return Plan({s: i for i, s in enumerate(names)}, targets, store, key[order], piece[order], at[order], block_rows)

    def place(self, source: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(block, release, deadline, slot, position) of rows by source and rank in it."""
        block = rank // self.block_rows
        want = source << 40 | block
        entry = np.searchsorted(self.key, want, side="right") - 1
        at = self.at[entry] + want - self.key[entry]
        out = np.empty((4, len(rank)), np.int64)
        for p in np.unique(self.piece[entry]).tolist():
            here = np.flatnonzero(self.piece[entry] == p)
            out[:, here] = self.store.load(f"piece-{p}")[:, at[here]]
        return block, out[0], out[1], out[2], out[3] + rank % self.block_rows


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, k1, k2, target, block, release, deadline, slot, position): where every row goes in the mixture.

    weights: of each source; without them, the square root of its rows. Within a source rows are ordered by a hash, so
    that its blocks are alike. position is gapless from 0. A source that runs out leaves its later slots empty, and the
    others keep their weights among each other; no row is dropped or repeated, and equal rows take a place each. target
    is the given weight over all weights. A null source is a source; one without a weight, and more than MAX_SOURCES, are
    errors. k1 and k2 hash the text (null as empty) and name the row with doc_id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *text_key(F.col("text").cast("string")))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "k1"))
    counts = {r[0]: r[1] for r in rows.groupBy("source").count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    if weights is None:
        weights = {s: n**0.5 for s, n in counts.items()}
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"sources without a weight: {missing[:5]}")
    plan = spark.sparkContext.broadcast(Plan.of(spark, weights, counts, block_rows))  # some numbers of each source and piece
    order = ranked(rows, ["source"], ["h", "doc_id", "k1", "k2"], "rank")
    names = ["doc_id", "source", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            source = np.array([p.names[x] for x in b.column(1).to_pylist()], np.int64)
            target = p.targets[source] if len(source) else np.zeros(0)
            out = p.place(source, b.column(4).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(target, pa.float64()), *map(pa.array, out)], [*names, "target", "block", "release", "deadline", "slot", "position"])

    schema = "doc_id long, source string, k1 long, k2 long, target double, block long, release long, deadline long, slot long, position long"
    return order.select(*names, "rank").mapInArrow(tidy(run), schema)


def reorder(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of docs, all columns as they are, sorted into the mixture's order: partition by partition, row by row. What
    holds of ``mix`` holds here. Rows move once: their places are looked up in files, not joined."""
    # equal rows share (doc_id, source, k1, k2); any of their positions serves any of them
    placed = mix(docs, weights, block_rows).select(*row_keys(*map(F.col, ("doc_id", "source", "k1", "k2"))), "position")
    places = KeyFile(placed.groupBy("key", "check").agg(F.min("position").alias("position")), "places", paired=True)
    check, at = unused(docs.columns, "check", "position")
    key, second = row_keys(F.col("doc_id").cast("long"), F.col("source").cast("string"), *text_key(F.col("text").cast("string")))
    keyed = docs.select("*", second.alias(check), key.alias(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = places.values(*(b.column(b.num_columns - i).to_numpy(zero_copy_only=False) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], schema=b.schema)

    return keyed.mapInArrow(tidy(run), keyed.schema).repartitionByRange(at).sortWithinPartitions(at).select(*[F.col(f"`{c}`") for c in docs.columns])
