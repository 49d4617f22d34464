"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first virtual node clockwise of its hash; where that node's shard is full, it continues clockwise. An
arc is the keys between two neighbouring nodes. The driver counts arcs (their number is fixed: shards * vnodes) and
walks their surplus clockwise; each arc then has a short list of shards with a number of its keys for each, and a key's
rank in its arc says which.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ranked, text_key, tidy

SHARDS, VNODES = 16, 256


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted signed positions of the virtual nodes and their shards; a node's place does not depend on ``shards``."""
    at = np.array([xxhash.xxh64_intdigest(f"{s}/{v}", 1) for s in range(shards) for v in range(vnodes)], np.uint64).view(np.int64)
    order = np.lexsort((np.repeat(np.arange(shards), vnodes), at))
    return at[order], np.repeat(np.arange(shards), vnodes)[order]


def capacities(total: int, shards: int, load: float) -> np.ndarray:
    """load 1: total is dealt out exactly, counts at most one apart; above 1: each shard may hold load times its share."""
    if load < 1:
        raise ValueError("the load bound is 1 at least")
    if load == 1:
        return total // shards + (np.arange(shards) < total % shards)
    return np.full(shards, int(np.ceil(load * total / shards)))


def allot(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each arc its (shard, keys) in the order of its ranks. In each round every arc offers what is left of it to
    its next shard clockwise, and a shard takes offers in ring order while it has room."""
    n, room = len(owner), room.copy()
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    left = counts.copy()
    at = np.arange(n)
    while left.any():
        arcs = np.flatnonzero(left)
        moved = False
        for arc in arcs.tolist():
            s = int(owner[at[arc]])
            take = int(min(left[arc], room[s]))
            if take:
                out[arc].append((s, take))
                left[arc] -= take
                room[s] -= take
                moved = True
            at[arc] = (at[arc] + 1) % n
        if not moved and not room.any():
            raise ValueError("the shards have no room for all keys")
    return out


def place(keys: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, load: float = 1.0) -> DataFrame:
    """Adds shard to rows that have h (the key's 64-bit hash, the place on the ring), doc_id, k1 and k2."""
    where, owner = ring(shards, vnodes)
    shared = keys.sparkSession.sparkContext.broadcast(where)
    names = keys.columns

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(names.index("h")).to_numpy(zero_copy_only=False)
            arc = np.searchsorted(shared.value, h, side="left") % len(shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arc.astype(np.int32))], [*names, "arc"])

    kind = ", ".join(f"`{c}` {t}" for c, t in keys.dtypes)
    on_ring = ranked(keys.mapInArrow(tidy(arcs), f"{kind}, arc int"), ["arc"], ["h", "doc_id", "k1", "k2"], "r")
    counts = np.zeros(len(owner), np.int64)
    for row in on_ring.groupBy("arc").count().collect():  # shards * vnodes rows at most
        counts[row[0]] = row[1]
    lists = allot(counts, owner, capacities(int(counts.sum()), shards, load))
    ends = [(np.cumsum([k for _, k in x]), np.array([s for s, _ in x], np.int32)) for x in lists]
    plan = keys.sparkSession.sparkContext.broadcast(ends)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arc, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("arc", "r"))
            out = np.empty(len(arc), np.int32)
            for a in np.unique(arc).tolist():
                at = np.flatnonzero(arc == a)
                cum, shard = plan.value[a]
                out[at] = shard[np.searchsorted(cum, r[at], side="right")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(out)], [*names, "shard"])

    return on_ring.select(*names, "arc", "r").mapInArrow(tidy(chosen), f"{kind}, shard int")


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, load: float = 1.0, positions: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2, shard, slot): every row with its shard and its gapless slot in it.

    The key is doc_id with the text's hash, so that no value of doc_id (null neither) weighs on one arc. Null texts
    have no bytes. Slots follow the ring or, where given, ``positions`` (doc_id, k1, k2, position): an order of the rows, 0
    and up, of which a row without one comes last. Repeated rows take one slot each. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        *text_key(text), F.xxhash64("doc_id", text).alias("h"),
    )
    order = ["h", "doc_id", "k1", "k2"]
    if positions is not None:
        p = positions.groupBy(F.col("doc_id").alias("__d"), F.col("k1").alias("__1"), F.col("k2").alias("__2")).agg(F.min("position").alias("position"))
        last = p.agg(F.max("position")).first()[0]
        # spread over the longs, so that ranks can be dealt out by its ranges
        step = (2**62) // (int(last or 0) + 1)
        on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2"))
        keys = keys.join(p, on, "left").drop("__d", "__1", "__2")
        keys = keys.withColumn("at", F.coalesce((F.col("position") * F.lit(step) - F.lit(2**61)) * 2, F.lit(2**63 - 1)))
        order = ["at", *order]
    return ranked(place(keys, shards, vnodes, load), ["shard"], order, "slot").drop("h", "at")
