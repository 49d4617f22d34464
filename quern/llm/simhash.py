"""Near duplicates by SimHash: fingerprints, and a binary-trie self-join of them.

The trie is the sorted array of distinct fingerprints: a node is a range of it. Pairs of nodes are walked down
together, level by level; a pair carries the bits in which its two prefixes differ and is dropped as soon as they
exceed the budget. To deal the walk out, every fingerprint is also rotated so that each of budget + 1 blocks of bits
comes first once: two fingerprints within the budget agree in one whole block, and so meet in the task that holds the
subtree under that block's value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunked, components, cut, spanning, tidy

U1 = np.uint64(1)


def shingles(text: str | None, k: int) -> list[bytes]:
    """k-word shingles of the lower-cased (A-Z) text, repeats included; fewer words: the whole sequence; none: []."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= k:
        return [flat]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    return [flat[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64; no words: 0."""
    parts = shingles(text, k)
    if not parts:
        return 0
    one = xxhash.xxh64_intdigest
    h = np.fromiter([one(x, seed) for x in parts], np.uint64, len(parts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        total += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Null and empty texts: 0."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), k, seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return kept.mapInArrow(tidy(run), "doc_id long, fp long")


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of which range, and the index, of every element of the ranges [lo, hi)."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _halves(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: int) -> np.ndarray:
    """Of each range [lo, hi) of sorted keys that agree in their first t bits, the first place whose bit t is set."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        up = keys[np.minimum(mid, len(keys) - 1)] >> np.uint64(63 - t) & U1 == 1
        hi = np.where(open_ & up, mid, hi)
        lo = np.where(open_ & ~up, mid + 1, lo)
    return lo


class Labels:
    """Which component each of n sorted keys is known to be in. ``changes`` counts the label's changes up to a key, so that
    a range is of one label where its ends have one count."""

    def __init__(self, label: np.ndarray):
        self.set(label)

    def set(self, label: np.ndarray) -> None:
        self.label = label
        self.changes = np.cumsum(np.r_[0, label[1:] != label[:-1]]) if len(label) else label

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.set(spanning(len(self.label), i, j, self.label))


def trie_pairs(keys: np.ndarray, heads: np.ndarray, budget: int, known: Labels, leaf: int = 64, step: int = 1 << 16, skip: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of one head and different labels whose 64-bit keys differ in at most ``budget`` bits, some
    at a time. Rows are sorted by head and key; every head roots a trie, whose keys agree in their first ``skip`` bits.
    Nodes of one label are not walked: whoever takes the pairs may join labels in between."""
    n = len(keys)
    if n < 2:
        return
    cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1], True])
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    stack = [(skip, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int8))]
    while stack:
        t, al, ah, bl, bh, err = stack.pop()
        if len(al) > step:
            half = len(al) // 2
            stack += [(t, *(x[:half] for x in (al, ah, bl, bh, err))), (t, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        one = (known.changes[ah - 1] == known.changes[al]) & (known.changes[bh - 1] == known.changes[bl]) & (known.label[al] == known.label[bl])
        small = ((ah - al) * (bh - bl) <= leaf) | (t >= 64)
        now = small & ~one
        of, first = _ranges(al[now], ah[now])
        first_j = np.where((al == bl)[now][of], first + 1, bl[now][of])
        last_j = bh[now][of]
        total = np.cumsum(last_j - first_j)
        at = 0
        while at < len(first):  # a quarter of a million comparisons at a time
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18), "right")))
            of2, j = _ranges(first_j[at:end], last_j[at:end])
            i = first[at:end][of2]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            i, j = i[near], j[near]
            apart = known.label[i] != known.label[j]
            if apart.any():
                yield i[apart], j[apart]
            at = end
        go = ~small & ~one
        if not go.any():
            continue
        al, ah, bl, bh, err = (x[go] for x in (al, ah, bl, bh, err))
        own = al == bl
        am, bm = _halves(keys, al, ah, t), _halves(keys, bl, bh, t)
        kids = [
            (al, am, bl, bm, err, np.ones(len(al), bool)),
            (am, ah, bm, bh, err, np.ones(len(al), bool)),
            (al, am, bm, bh, err + 1, err < budget),
            (am, ah, bl, bm, err + 1, (err < budget) & ~own),
        ]
        rows = [np.concatenate(x) for x in zip(*kids)]
        ok = rows[5] & (rows[1] > rows[0]) & (rows[3] > rows[2]) & ~((rows[0] == rows[2]) & (rows[1] - rows[0] < 2))
        if ok.any():
            stack.append((t + 1, *(x[ok] for x in rows[:5])))


def trie_links(keys: np.ndarray, budget: int, skip: int = 0) -> np.ndarray:
    """Component labels (smallest index) of sorted distinct 64-bit keys that are linked where they agree in their first
    ``skip`` bits and differ in at most ``budget`` bits. The walk is repeated with a rising budget: what near links join
    is not walked for far ones."""
    known = Labels(np.arange(len(keys)))
    heads = keys >> np.uint64(64 - skip) if skip else np.zeros(len(keys), np.uint64)
    for k in range(1, budget + 1):
        for i, j in trie_pairs(keys, heads, k, known, skip=skip):
            known.join(i, j)
    return known.label


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the budget + 1 blocks of 64 bits."""
    cuts = np.linspace(0, 64, budget + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


#: Rotated fingerprints that one task joins, about, and those of one head that are joined in one.
TASK_KEYS = 1_000_000


def links(fps: DataFrame, budget: int = 3, task_keys: int = TASK_KEYS) -> DataFrame:
    """(src, dst): enough links between the distinct ``fp`` at most ``budget`` bits apart to span every component. A head
    that over ``task_keys`` fingerprints share is cut into chunks, each pair of which is a task's."""
    if not 0 <= budget < 16:
        raise ValueError("the budget is 0 to 15 bits of 64")
    blocks = _blocks(budget)
    rotated = [F.struct(F.lit(i).alias("r"), (F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", 64 - a)) if a else F.col("fp")).alias("key")) for i, (a, _) in enumerate(blocks)]
    # the bits of the first block choose the task; sorted as signed longs, which groups equal first blocks all the same
    head = F.shiftright("key", 64 - min(w for _, w in blocks))
    distinct = fps.select("fp").distinct()
    n = distinct.count() * len(blocks)
    dealt = distinct.select(F.explode(F.array(*rotated)).alias("x")).select("x.r", "x.key").withColumn("head", head)
    dealt = chunked(dealt, ["r", "head"], "key", task_keys) if n > task_keys else dealt.withColumn("chunk", F.lit(0).cast("long"))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // task_keys))
    dealt = dealt.repartition(parts, "r", "head", "chunk").sortWithinPartitions("r", "chunk", "key").select("r", "key", "chunk")
    widths = dict(enumerate(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if not parts:
            return
        r, key, chunk = (np.concatenate(x) for x in zip(*parts))
        cuts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (chunk[1:] != chunk[:-1]), True]).tolist()
        for start, end in zip(cuts, cuts[1:]):
            keys = np.sort(key[start:end].view(np.uint64))
            a, w = widths[int(r[start])]
            lab = trie_links(keys, budget, w)
            at = np.flatnonzero(lab != np.arange(len(keys)))
            back = (keys << np.uint64(64 - a)) | (keys >> np.uint64(a)) if a else keys
            out = [pa.array(np.ascontiguousarray(back[x]).view(np.int64)) for x in (at, lab[at])]
            if len(at):
                yield pa.RecordBatch.from_arrays(out, ["src", "dst"])

    return dealt.mapInArrow(tidy(run), "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = 3, budget: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most ``budget`` bits.

    Null and empty texts share fingerprint 0 and link like any other; repeated rows are returned as often as they
    come. A null doc_id links what it stands between and gets its class's smallest doc_id; where a class has none but
    null, component_id is null. No rows give none.
    """
    fps = cut(fingerprints(docs, k, seed, text, doc_id))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(links(reps, budget))
    classed = reps.join(comp, reps.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
    named = classed.groupBy("class").agg(F.min("rep").alias("component_id"))
    return fps.join(classed.select("fp", "class").join(named, "class").drop("class"), "fp").select("doc_id", "fp", "component_id")
