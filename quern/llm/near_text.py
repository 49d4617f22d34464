"""Near-duplicate filtering by wide SimHash fingerprints of word shingles, joined by operator 5's trie walk.

A text's set of k-word shingles is folded into a signed count vector and projected to 1024 bits. Sets of Jaccard
similarity J have cosine 2J / (1 + J), and each bit differs with the probability angle / pi. Many tables each take some
of the bits as a text's head. Texts of one head root a trie over 64 further bits, whose node pairs ``simhash.trie_pairs``
walks with an error budget; its pairs are judged on 128 and then on all bits, and last on the whole shingle sets. Only a
pair whose sets reach the similarity links, and at once: what is linked is not walked again, so that a group of n copies
costs some n comparisons of sets, and gives n - 1 links.

How many bits a head takes, and so how many tables a pair needs to meet in one, follows from the number of texts
(``Tables.of``). Sets and fingerprints lie in files in the shared folder, of which workers read what they compare, some
sets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunked, components, cut, scratch, text_key, tidy, unused
from quern.llm.kneser_ney import Store, _Hashes
from quern.llm.simhash import Labels, trie_pairs

BITS, FOLD = 1024, 4096
WORDS = BITS // 64
#: By how much the share of differing bits strays because of the fold (its standard deviation, by experiment).
FOLD_SPREAD = 0.011
#: Texts that should share a head, on average; the share of pairs right at the similarity that no table brings together.
GROUP_TEXTS, MISSED = 256, 0.0001
#: Texts of one head that one task takes; larger groups are cut into chunks, and each pair of chunks is a task's.
TASK_TEXTS = 1_000_000
#: Words of 64 bits that a file of sets holds before the next one is begun.
FILE_WORDS = 1 << 23
#: Words of sets that a task reads at once to compare them, about.
READ_WORDS = 1 << 21
#: Sets of fewer shingles are kept in all 64 bits of their hashes, others in 32.
SMALL_SET = 64
_MATRIX: list[np.ndarray] = []


def shingle_set(text: str | None, k: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the lower-cased (A-Z) text; fewer words: the whole."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : len(ids) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.unique(h)


def wide_bits(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BITS / 64) fingerprints of shingle sets; empty sets: zeros."""
    if not _MATRIX:
        _MATRIX.append((np.random.default_rng(11).integers(0, 2, (FOLD, BITS), np.int8) * 2 - 1).astype(np.float32))
    out = np.zeros((len(sets), WORDS), np.uint64)
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        h = np.concatenate([*part, np.zeros(0, np.uint64)])
        sign = (h & np.uint64(1)).astype(np.float64) * 2 - 1
        x = np.bincount(row * FOLD + (h >> np.uint64(64 - 12)).astype(np.int64), sign, len(part) * FOLD)
        y = x.astype(np.float32).reshape(len(part), FOLD) @ _MATRIX[0]
        out[at : at + len(part)] = np.packbits(y > 0, axis=1, bitorder="little").view(np.uint64)
    return out


def differing(similarity: float) -> float:
    """The share of bits in which sets of this Jaccard similarity are expected to differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def stored(s: np.ndarray) -> np.ndarray:
    """A set as it is kept: its size and its hashes, as whole 64-bit words."""
    x = s
    if len(s) >= SMALL_SET:
        short = np.unique((s >> np.uint64(16)).astype(np.uint32))
        x = np.zeros(len(short) + len(short) % 2, np.uint32)
        x[: len(short)] = short
        return np.r_[np.uint64(len(short) << 1 | 1), x.view(np.uint64)]
    return np.r_[np.uint64(len(s) << 1), x]


def _short(s: np.ndarray) -> np.ndarray:
    return s if s.dtype == np.uint32 else np.unique((s >> np.uint64(16)).astype(np.uint32))


def reach(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets with these numbers (each sorted and distinct) have at least this Jaccard similarity, pair by pair."""
    enough = lambda n, both: n >= similarity * (both - n) - 1e-9
    size = np.array([len(s) for s in sets], np.int64)
    out = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
    short = {i: _short(sets[i]) for i in np.unique(np.r_[x[out], y[out]]).tolist()}
    todo = np.flatnonzero(out)
    total = np.cumsum(size[x[todo]] + size[y[todo]])
    at = 0
    while at < len(todo):  # some millions of hashes at a time: those that both sets hold come twice
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 21), "right")))
        some = todo[at:end]
        flat = np.concatenate([short[i] for pair in zip(x[some].tolist(), y[some].tolist()) for i in pair]).astype(np.uint64)
        sizes = np.array([[len(short[i]) for i in c[some].tolist()] for c in (x, y)]).sum(axis=0)
        flat |= np.repeat(np.arange(len(some), dtype=np.uint64) << np.uint64(32), sizes)
        flat.sort()
        twice = flat[1:][flat[1:] == flat[:-1]] >> np.uint64(32)
        out[some] = enough(np.bincount(twice.astype(np.int64), minlength=len(some)), sizes)
        at = end
    for n in np.flatnonzero(out).tolist():  # small sets again, by all bits
        a, b = sets[x[n]], sets[y[n]]
        if a.dtype == b.dtype == np.uint64:
            out[n] = enough(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b))
    return out


@dataclass
class Tables:
    """The bits that are each table's head, and the budgets of 64, 128 and all bits."""

    columns: np.ndarray  # (tables, width)
    near: int
    nearer: int
    most: int

    @staticmethod
    def of(texts: int, similarity: float) -> Tables:
        """Heads of so many bits that about GROUP_TEXTS texts share one, and tables until a pair at the similarity, whose
        bits differ by a spread more than expected, misses all of them with the probability MISSED."""
        mean = differing(similarity)
        width = int(np.clip(ceil(log2(max(1, texts / GROUP_TEXTS))), 4, 40))
        count = ceil(log(MISSED) / log(1 - (1 - mean - FOLD_SPREAD) ** width))
        rng = np.random.default_rng(5)
        spread = lambda n, z: sqrt(mean * (1 - mean) / n + FOLD_SPREAD**2) * z * n
        # a budget in each table, so that the looser ones cost little recall; all bits are judged once
        return Tables(np.stack([rng.choice(BITS, width, replace=False) for _ in range(count)]), int(64 * mean + spread(64, 3.7)), int(128 * mean + spread(128, 3.7)), int(BITS * mean + spread(BITS, 4.5)))

    def heads(self, fp: np.ndarray) -> np.ndarray:
        """(texts, tables): each text's head, which names its table too."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), BITS // 8), axis=1, bitorder="little")
        out = np.empty((len(fp), len(self.columns)), np.int64)
        power = 1 << np.arange(self.columns.shape[1], dtype=np.int64)
        for t, c in enumerate(self.columns):
            out[:, t] = bits[:, c] @ power | t << 48
        return out

    def first(self, ha: np.ndarray, hb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of texts, the first table that brings them together within its budgets."""
        d = np.bitwise_count(a ^ b).astype(np.int32)
        one = d[:, np.arange(len(self.columns)) % WORDS]
        two = one + d[:, (np.arange(len(self.columns)) + 1) % WORDS]
        return np.argmax((ha == hb) & (one <= self.near) & (two <= self.nearer), axis=1)


class Sets:
    """Fingerprints and sets by reference: the number of a file, and where in it a text's begin."""

    def __init__(self, store: Store):
        self.store = store

    def _read(self, ref: int, begin: int, end: int) -> np.ndarray:
        at = ref & 0xFFFFFF
        return self.store.part(f"sets-{ref >> 24}", at + begin, at + end)

    def fingerprints(self, refs: np.ndarray) -> np.ndarray:
        out = np.empty((len(refs), WORDS), np.uint64)
        for i in np.argsort(refs).tolist():  # file by file
            out[i] = self._read(int(refs[i]), 0, WORDS)
        return out

    def set(self, ref: int, size: int | None = None) -> np.ndarray:
        """size: the word that begins a set as ``stored``."""
        n = int(self._read(ref, WORDS, WORDS + 1)[0]) if size is None else size
        x = self._read(ref, WORDS + 1, WORDS + 1 + ((n >> 1) + 1 >> 1 if n & 1 else n >> 1))
        return x.view(np.uint32)[: n >> 1] if n & 1 else x

    def alike(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the sets by these references reach the similarity, pair by pair; those of about READ_WORDS words are read
        at a time, and none of a pair whose sizes are too far apart."""
        refs, back = np.unique(np.r_[a, b], return_inverse=True)
        x, y = back[: len(a)], back[len(a) :]
        size = np.array([self._read(r, WORDS, WORDS + 1)[0] for r in refs.tolist()], np.int64)
        n, words = size >> 1, np.where(size & 1, (size >> 1) + 1 >> 1, size >> 1)
        out = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
        todo = np.flatnonzero(out)
        total = np.cumsum(words[x[todo]] + words[y[todo]])
        at = 0
        while at < len(todo):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + READ_WORDS, "right")))
            some = todo[at:end]
            need, back = np.unique(np.r_[x[some], y[some]], return_inverse=True)
            out[some] = reach([self.set(int(refs[v]), int(size[v])) for v in need.tolist()], back[: len(some)], back[len(some) :], similarity)
            at = end
        return out


def _fingerprinted(docs: DataFrame, k: int, store: Store) -> DataFrame:
    """(doc_id, k1, k2, fp, ref): fp holds BITS bits and ref names the stored set; both are null where the text has no
    word. A task writes files of its own, and names them by itself, so that what a lost task wrote is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _Hashes(), [], 0
        file = TaskContext.get().taskAttemptId() << 10
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                sets = [shingle_set(x.as_py(), k, hashes) for x in b.column(3)]
                bits, refs = wide_bits(sets), []
                for x, s in zip(bits, sets):
                    if not len(s):
                        refs.append(None)
                        continue
                    refs.append(file << 24 | size)
                    held += [x, stored(s)]
                    size += len(x) + len(held[-1])
                    if size >= FILE_WORDS:
                        store.save(f"sets-{file}", np.concatenate(held))
                        file, held, size = file + 1, [], 0
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() if len(s) else None for x, s in zip(bits, sets)], pa.binary()), pa.array(refs, pa.int64())], ["doc_id", "k1", "k2", "fp", "ref"])
        if held:
            store.save(f"sets-{file}", np.concatenate(held))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text")).mapInArrow(tidy(run), "doc_id long, k1 long, k2 long, fp binary, ref long")


def _links(texts: DataFrame, n: int, sets: Sets, tables: Tables, similarity: float, task_texts: int) -> DataFrame:
    """(src, dst): references of texts (ref, fp) whose sets reach the similarity, enough to span every component."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                fp = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                heads = tables.heads(fp)
                for t in range(heads.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (heads[:, t], fp[:, t % WORDS].view(np.int64), fp[:, (t + 1) % WORDS].view(np.int64))] + [b.column(0)], ["head", "s0", "s1", "ref"])

    dealt = texts.select("ref", "fp").mapInArrow(tidy(deal), "head long, s0 long, s1 long, ref long")
    dealt = chunked(dealt, ["head"], "ref", task_texts) if n > task_texts else dealt.withColumn("chunk", F.lit(0).cast("long"))
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(tables.columns) // 1_000_000))
    dealt = dealt.repartition(parts, "head", "chunk").sortWithinPartitions("head", "chunk", "s0", "ref")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if not parts:
            return
        head, s0, s1, ref, chunk = (np.concatenate(x) for x in zip(*parts))
        del parts
        # sorted as signed longs: with the sign bit turned over, which no distance sees, they are sorted as unsigned ones
        key, more = s0.view(np.uint64) ^ np.uint64(1 << 63), s1.view(np.uint64)
        group = np.cumsum(np.r_[False, (head[1:] != head[:-1]) | (chunk[1:] != chunk[:-1])])
        known = Labels(np.arange(len(key)))
        last = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
        src, dst = [], []

        def judge(i: np.ndarray, j: np.ndarray) -> None:
            """Links the pairs whose sets reach the similarity; a few at first, as each link may answer others."""
            ok = np.bitwise_count(more[i] ^ more[j]) + np.bitwise_count(key[i] ^ key[j]) <= tables.nearer
            i, j, step = i[ok], j[ok], 64
            while len(i):
                a, b = i[:step], j[:step]
                some, back = np.unique(np.r_[a, b], return_inverse=True)
                fp = sets.fingerprints(ref[some])
                x, y = back[: len(a)], back[len(a) :]
                ok = (np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int32) <= tables.most) & (ref[a] != ref[b])
                a, b, x, y = a[ok], b[ok], x[ok], y[ok]
                need, back = np.unique(np.r_[x, y], return_inverse=True)
                h = tables.heads(fp[need])
                ok = tables.first(h[back[: len(x)]], h[back[len(x) :]], fp[x], fp[y]) == head[a] >> 48
                a, b = a[ok], b[ok]
                ok = sets.alike(ref[a], ref[b], similarity)
                a, b = a[ok], b[ok]
                linked, lab, up = np.zeros(len(a), bool), known.label, {}

                def root(v: int, lab=lab, up=up) -> int:
                    v = int(lab[v])
                    while v in up:
                        v = up[v]
                    return v

                for n, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
                    p, q = root(u), root(v)
                    if p != q:
                        linked[n] = True
                        up[max(p, q)] = min(p, q)
                known.join(a[linked], b[linked])
                src.append(ref[a[linked]])
                dst.append(ref[b[linked]])
                i, j = i[step:], j[step:]
                apart = known.label[i] != known.label[j]
                i, j, step = i[apart], j[apart], min(2 * step, 1 << 14)

        # neighbours in the sorted order come first: they join most of a large group
        by = np.setdiff1d(np.arange(len(key) - 1), last)
        by = by[np.bitwise_count(key[by] ^ key[by + 1]) <= tables.near]
        for a in range(0, len(by), 1 << 14):
            judge(by[a : a + (1 << 14)], by[a : a + (1 << 14)] + 1)
        for budget in sorted({tables.near // 4, tables.near // 2, tables.near}):
            for i, j in trie_pairs(key, group, budget, known):
                judge(i, j)
            if src and sum(map(len, src)) >= 1 << 16:
                yield _pairs(src, dst)
                src.clear(), dst.clear()
        yield _pairs(src, dst)

    return dealt.mapInArrow(tidy(meet), "src long, dst long")


def _pairs(src: list, dst: list) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, none])) for x in (src, dst)], ["src", "dst"])


def classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, task_texts: int = TASK_TEXTS) -> DataFrame:
    """(doc_id, k1, k2, component): every row's class of near-duplicate texts; component names the class.

    Texts are linked whose k-word shingle sets reach the Jaccard similarity: texts equal in all characters (null as
    empty) always, others as the fingerprints find them; no pair is linked whose whole sets don't reach it (sets of 64 or
    more shingles by 32 bits of their hashes, up to collisions of these). Very long texts are taken whole. Texts without
    a word link to equal ones only. A null doc_id is answered like any other, repeated rows are answered one by one, and
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = Sets(Store(scratch(spark, "sets")))
    rows = cut(_fingerprinted(docs, k, sets.store))
    # equal texts have equal fingerprints, whichever row's files are read
    texts = cut(rows.groupBy("k1", "k2").agg(F.min("ref").alias("ref"), F.min("fp").alias("fp")))
    n = texts.count()
    found = components(cut(_links(texts.where("fp is not null"), n, sets, Tables.of(n, similarity), similarity, task_texts)))
    # a text without a word is a class of its own; references are not negative
    own = F.when(F.col("ref").isNull(), -1 - F.abs(F.col("k1") % (2**62))).otherwise(F.col("ref"))
    named = texts.join(found, texts.ref == found.node, "left").select("k1", "k2", F.coalesce("component", own).alias("component"))
    return rows.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "k1", "k2", "component")


class KeyFile:
    """A set of distinct longs, each with a long of its own where a second column is given, as sorted arrays in the shared
    folder, one for each value of the top bits; workers map them. ``paired``: keys are of 128 bits, in two columns."""

    def __init__(self, keys: DataFrame, name: str, paired: bool = False):
        n = keys.count()
        self.bits = max(0, int(np.ceil(np.log2(max(1, n / 1_000_000)))))
        self.store = store = Store(scratch(keys.sparkSession, name))
        bits, key = self.bits, keys.columns[0]
        check = F.col(keys.columns[1]) if paired else F.lit(0).cast("long")
        own = keys.columns[1 + paired :]

        def save(t: pa.Table) -> pa.Table:
            part = t["part"][0].as_py()
            k, c = t["key"].to_numpy(), t["check"].to_numpy()
            order = np.lexsort((c, k))
            k, c = k[order], c[order]
            first = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
            store.save(f"keys-{part}", k[first])
            if paired:
                store.save(f"checks-{part}", c[first])
            if own:
                store.save(f"values-{part}", t["value"].to_numpy()[order][first])
            return pa.table({"part": pa.array([part], pa.int32())})

        part = (F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0)).cast("int")
        value = F.col(own[0]) if own else F.lit(0).cast("long")
        self.paired = paired
        self.parts = sorted(r.part for r in keys.select(part.alias("part"), F.col(key).alias("key"), check.alias("check"), value.alias("value")).groupBy("part").applyInArrow(save, "part int").collect())

    def _look(self, keys: np.ndarray, checks: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        part = (keys.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for p in np.intersect1d(part, self.parts).tolist():
            at = np.flatnonzero(part == p)
            have = self.store.load(f"keys-{p}")
            i = np.searchsorted(have, keys[at])
            inside = lambda i, have=have: np.minimum(i, len(have) - 1)
            hit = have[inside(i)] == keys[at]
            if self.paired:  # of several keys with one first half the one with the second, if any
                second, open_ = self.store.load(f"checks-{p}"), hit
                hit = open_ & (second[inside(i)] == checks[at])
                while (open_ := open_ & ~hit).any():
                    i = i + open_
                    open_ = open_ & (i < len(have)) & (have[inside(i)] == keys[at])
                    hit = hit | open_ & (second[inside(i)] == checks[at])
            yield p, at, inside(i), hit

    def contains(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for _, at, _, hit in self._look(keys, checks):
            out[at] = hit
        return out

    def values(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """The keys' values, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        for p, at, i, hit in self._look(keys, checks):
            out[at] = np.where(hit, self.store.load(f"values-{p}")[i], -1)
        return out


def half(seed: int, *columns) -> Column:
    """One of the two independent 64-bit hashes that name a row together, nulls told from all values."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c, c.isNull())])


def row_keys(*columns) -> list[Column]:
    """(key, check): 128 bits that name a row by its columns."""
    return [half(1, *columns).alias("key"), half(2, *columns).alias("check")]


def _holding(docs: DataFrame, keys: KeyFile) -> DataFrame:
    """The rows of docs, all columns as they are, whose row key is in the set."""
    names = unused(docs.columns, "row_key", "row_check")
    marked = docs.select("*", *[k.alias(n) for k, n in zip(row_keys(F.col("doc_id").cast("long"), *text_key(F.col("text").cast("string"))), names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = keys.contains(*(b.column(b.num_columns - i).to_numpy(zero_copy_only=False) for i in (2, 1)))
            yield pa.RecordBatch.from_arrays(b.columns[:-2], schema=pa.schema([b.schema.field(i) for i in range(b.num_columns - 2)])).filter(pa.array(ok))

    return marked.mapInArrow(tidy(run), docs.schema)


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, of which one stays of each class (see ``classes``): the one with the
    smallest doc_id, ties by the text's hash; a null doc_id comes last. Of rows that are equal in these the one stays whose
    columns have the smallest hash (maps, which have none, are left out of it), so that rows repeated whole stay once."""
    found = cut(classes(docs, k, similarity))
    # a struct's null field would come first, so that nulls are ordered by a flag of their own
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("m")).select(*row_keys(F.col("m.doc_id"), F.col("m.k1"), F.col("m.k2")))
    by = found.groupBy(*row_keys(F.col("doc_id"), F.col("k1"), F.col("k2"))).agg(F.count(F.lit(1)).alias("n"))
    stays = cut(by.join(best, ["key", "check"]))
    kept = _holding(docs, KeyFile(stays.where("n = 1").select("key", "check"), "stays", paired=True))
    if stays.where("n > 1").limit(1).count() == 0:
        return kept
    again = _holding(docs, KeyFile(stays.where("n > 1").select("key", "check"), "repeated", paired=True))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = again.select(*row_keys(F.col("doc_id").cast("long"), *text_key(F.col("text").cast("string"))), F.xxhash64(*hashed).alias("h"), F.struct("*").alias("row"))
    one = one.groupBy("key", "check").agg(F.min_by("row", "h").alias("row"))
    return kept.unionAll(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
