"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that a document holds with at most k edits shares at least m + 1 - q - k * q character q-grams
with it, all within k + 1 neighbouring diagonals (document position less item position). Shared q-grams are counted in
bands of 2 * (k + 1) diagonals that overlap by half, so that some band holds them all; bands that reach the bound are
verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, scratch, small_batches, tidy
from quern.llm.kneser_ney import Store

Q, MIN_Q, EDIT_RATE = 8, 3, 0.1
#: Characters of the benchmark that one index holds, about; documents looked through at once; and pairs of places.
BLOCK_CHARS, DOCS, POSTINGS = 2_000_000, 128, 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_BITS = 22


def normal(text: str | None) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of each q-gram, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    part, width = codes.astype(np.uint64), 1
    out, have = None, 0
    n = len(codes) - q + 1
    left = q
    while True:
        if left & 1:
            piece = part[have : have + n]
            out = piece.copy() if out is None else out * np.uint64(pow(_B, width, 2**64)) + piece
            have += width
        left >>= 1
        if not left:
            return out
        part = part[:-width] * np.uint64(pow(_B, width, 2**64)) + part[width:]
        width *= 2


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)


def gram_size(m: int, q: int, rate: float) -> int:
    """The q-gram size for an item of m characters: q, or the largest below it for which the lemma bounds its edits."""
    return min(q, max(MIN_Q, m // (int(m * rate) + 1)))


@dataclass
class Index:
    """One block of items of one q-gram size: normalised texts, edit budgets, least shared q-grams, and where each q-gram
    stands. All are arrays, which workers map from the shared folder."""

    q: int
    ids: np.ndarray
    known: np.ndarray  # whether the id is not null
    codes: np.ndarray  # the texts' characters, one text after the other
    ends: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    table: np.ndarray
    short: np.ndarray

    @staticmethod
    def of(items: list[tuple], q: int = Q, rate: float = EDIT_RATE) -> Index:
        """items: (id, text). Those without a character are left out; those shorter than q must be held verbatim."""
        kept = [(i, normal(t)) for i, t in items]
        kept = [(i, t) for i, t in kept if t]
        m = np.array([len(t) for _, t in kept], np.int64)
        budget = np.clip(np.minimum((m * rate).astype(np.int64), (m - q) // q), 0, None)
        texts = [_codes(t) for _, t in kept]
        hashes = [grams(t, q) for t in texts]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(kept)), [len(h) for h in hashes]) if kept else np.zeros(0, np.int64)
        pos = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[_slot(keys)] = True
        small = lambda x: x.astype(np.int32)
        return Index(q, np.array([i or 0 for i, _ in kept], np.int64), np.array([i is not None for i, _ in kept], bool), np.concatenate([*texts, np.zeros(0, np.uint32)]), np.cumsum(m), budget, m + 1 - q - budget * q, keys, np.r_[first, len(flat)], small(item[order]), small(pos[order]), seen, np.flatnonzero(m < q))

    def id(self, i: int) -> int | None:
        return int(self.ids[i]) if self.known[i] else None

    def text(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i - 1] if i else 0 : self.ends[i]]

    def save(self, store: Store, name: str) -> None:
        for f in fields(self):
            store.save(f"{name}-{f.name}", np.asarray(getattr(self, f.name)))

    @staticmethod
    def load(store: Store, name: str) -> Index:
        found = {f.name: store.load(f"{name}-{f.name}") for f in fields(Index)}
        return Index(**found | {"q": int(found["q"])})


def _plain(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int]:
    """(edits, start, end) of the item's best place in the text, over the diagonals low to high only; as soon as no
    place is within the budget, (budget + 1, 0, 0)."""
    width, m, n = high - low + 1, len(item), len(text)
    steps = np.arange(width)
    big = m + n + 1
    start = low + steps  # text position before the first character
    cost = np.where((start >= 0) & (start <= n), 0, big)
    # the text character that each diagonal pairs with each of the item's, -1 and -2 outside
    reach = np.full(m + width, -1, np.int64)
    a, b = max(0, low), min(n, low + m + width)
    if b > a:
        reach[a - low : b - low] = text[a:b]
    up, up_start = np.full(width, big), np.zeros(width, np.int64)
    for i in range(m):
        near = reach[i : i + width]
        diag = cost + (near != item[i])
        diag[near < 0] = big
        up[:-1], up_start[:-1] = cost[1:] + 1, start[1:]  # item[i] is left out of the text
        take = up < diag
        run = np.where(take, up, diag) - steps  # characters that only the text has: a running minimum
        least = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == least, steps, 0))
        start = np.where(take, up_start, start)[source]
        cost = least + steps
        out = low + i + 1  # the text position after the first diagonal's character
        if out < 0:
            cost[:-out] = big
        if out + width - 1 > n:
            cost[max(0, n - out + 1) :] = big
        if cost.min() > budget:
            return budget + 1, 0, 0
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), low + best + m


def find(index: Index, texts: list[str]) -> list[list[tuple]]:
    """For each normalised text: (item id, start, end, edits) of every item that it holds, its best place."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(index.ids):
        return out
    for i in index.short.tolist():
        item = _plain(index.text(i))
        for d, t in enumerate(texts):
            if (at := t.find(item)) >= 0:
                out[d].append((index.id(i), at, at + len(item), 0))
    codes = [_codes(t) for t in texts]
    starts = np.cumsum([0, *(len(c) + 1 for c in codes)])
    flat = np.zeros(starts[-1], np.uint32)
    for a, c in zip(starts, codes):
        flat[a : a + len(c)] = c
    h = grams(flat, index.q)
    may = np.flatnonzero(index.table[_slot(h)])
    if not len(may) or not len(index.keys):
        return out
    k = np.minimum(np.searchsorted(index.keys, h[may]), len(index.keys) - 1)
    hit = index.keys[k] == h[may]
    may, k = may[hit], k[hit]
    doc = np.searchsorted(starts, may, side="right") - 1
    few = np.bincount(doc, minlength=len(texts))
    ok = few[doc] >= max(1, int(index.least.min(initial=1)))
    may, k, doc = may[ok], k[ok], doc[ok]
    for a in range(0, len(may), 1 << 18):
        _bands(index, codes, starts, may, k, doc, a, min(len(may), a + (1 << 18)), out, texts)
    return out


def _summed(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of all parts with their numbers; parts are added up as they come."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in parts:
        k, c = np.unique(x, return_counts=True)
        if not len(keys):
            keys, counts = k, c
            continue
        keys, back = np.unique(np.r_[keys, k], return_inverse=True)
        counts = np.bincount(back, np.r_[counts, c]).astype(np.int64)
    return keys, counts


def _bands(index, codes, starts, may, k, doc, a, b, out, texts) -> None:
    """Counts and verifies the bands of the documents whose first shared q-gram is among hits a to b. A q-gram may stand in
    many items: POSTINGS pairs of a place in a text and one in an item are looked at at once."""
    a = int(np.searchsorted(doc, doc[a - 1], side="right")) if a else 0  # a document begun earlier is done there
    b = int(np.searchsorted(doc, doc[b - 1], side="right"))
    if a >= b:
        return
    may, k, doc = may[a:b], k[a:b], doc[a:b]
    n = index.first[k + 1] - index.first[k]
    ends, n_items = np.cumsum(n), len(index.ids)
    least = np.maximum(1, index.least)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hit, posting) of all hits, in their order."""
        for at in range(0, int(ends[-1]), POSTINGS):
            x = np.arange(at, min(at + POSTINGS, int(ends[-1])))
            hit = np.searchsorted(ends, x, side="right")
            yield hit, x - (ends - n)[hit] + index.first[k[hit]]

    once = list(pairs()) if ends[-1] <= POSTINGS else None
    both = lambda of, at: (doc[of] - doc[0]) * n_items + index.item[at]
    pair, total = _summed(both(of, at) for of, at in once or pairs())
    pair = pair[total >= least[pair % n_items]]  # documents that share too few with an item in all go
    if not len(pair):
        return
    # a band is named by where it begins: between the first and the last diagonal of any document and item
    span = int(max(starts[-1], len(index.codes))) + 2
    bands = 2 * span

    def named() -> Iterator[np.ndarray]:
        for of, at in once or pairs():
            p = both(of, at)
            ok = pair[np.minimum(np.searchsorted(pair, p), len(pair) - 1)] == p
            of, at, p = of[ok], at[ok], p[ok]
            # the two bands that hold a diagonal begin at upper * half and (upper - 1) * half
            upper = (may[of] - starts[doc[of]] - index.pos[at]) // (index.budget[index.item[at]] + 1)
            key = p * bands + (upper + span)
            yield np.r_[key, key - 1]

    found, count = _summed(named())
    ok = count >= least[found // bands % n_items]
    found, count = found[ok], count[ok]
    found = np.stack([found // bands // n_items + doc[0], found // bands % n_items, found % bands - span], 1)
    best: dict[tuple, tuple] = {}
    for (dd, i, band), _ in sorted(zip(found.tolist(), count.tolist()), key=lambda x: -x[1]):
        if best.get((dd, i), (1,))[0] == 0:
            continue
        item = index.text(i)
        if (exact := texts[dd].find(_plain(item))) >= 0:
            best[dd, i] = (0, exact, exact + len(item))
            continue
        budget, m = int(index.budget[i]), len(item)
        low = band * (budget + 1) - budget
        high = (band + 2) * (budget + 1) + budget
        lo = max(0, low - 1)
        edits, s, e = align(item, codes[dd][lo : high + m + budget + 1], low - lo, high - lo, budget)
        if edits <= budget and ((dd, i) not in best or edits < best[dd, i][0]):
            best[dd, i] = (edits, s + lo, e + lo)
    for (dd, i), (edits, s, e) in sorted(best.items()):
        out[dd].append((index.id(i), s, e, edits))


@dataclass
class Benchmark:
    """The indexes of a benchmark's blocks in the shared folder: one is looked through at a time, and mapped, not held."""

    store: Store
    names: list[str]

    @staticmethod
    def of(benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> Benchmark:
        """Indexes are built in tasks, each of about ``block_chars`` characters of items of one q-gram size."""
        small_batches(benchmark.sparkSession)
        store = Store(scratch(benchmark.sparkSession, "benchmark"))

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = [len(normal(x.as_py())) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([gram_size(x, q, rate) for x in m], pa.int32()), pa.array(m, pa.int64())], ["i", "t", "q", "m"])

        items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").distinct()
        items = cut(items.mapInArrow(tidy(sizes), "i long, t string, q int, m long").where("m > 0"))
        blocks = {r.q: max(1, -(-r.m // block_chars)) for r in items.groupBy("q").agg(F.sum("m").alias("m")).collect()}  # q sizes at most
        if not blocks:
            return Benchmark(store, [])

        def build(t: pa.Table) -> pa.Table:
            size, block = t["q"][0].as_py(), t["block"][0].as_py()
            found = sorted(zip(t["i"].to_pylist(), t["t"].to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            Index.of(found, size, rate).save(store, f"{size}-{block}")
            return pa.table({"name": [f"{size}-{block}"]})

        number = F.coalesce(*(F.when(F.col("q") == size, F.pmod(F.xxhash64("i", "t"), F.lit(n))) for size, n in sorted(blocks.items())))
        dealt = items.select("i", "t", "q", number.alias("block")).repartition("q", "block").groupBy("q", "block")
        return Benchmark(store, sorted(r.name for r in dealt.applyInArrow(build, "name string").collect()))

    def find(self, texts: list[str]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        for name in self.names:
            for old, new in zip(out, find(Index.load(self.store, name), texts)):
                old += new
        return out


MATCHES = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, matches): every document with the items that it holds within the edit budget (``rate`` of the item's
    characters; short items go by shorter q-grams, down to MIN_Q), each at its best place in the normalised text.

    Null and empty texts hold nothing; items without text are left out; repeated rows are answered one by one, and so are
    documents whose doc_id is null. Items of equal id and text count once. An empty table gives no rows.
    """
    found = Benchmark.of(benchmark, q, rate, block_chars)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, DOCS):
                b = big.slice(at, DOCS)
                got = [sorted(x, key=lambda m: (m[0] is None, m[0] or 0, m[1])) for x in found.find([normal(x.as_py()) for x in b.column(1)])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("item_id", "start", "end", "edits"), m)) for m in x] for x in got], kind)], ["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id long, matches {MATCHES}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no benchmark item (see ``matches``). Null and empty texts stay;
    repeated rows go or stay together; without items everything stays."""
    at = docs.columns.index("text")
    found = Benchmark.of(benchmark, q, rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, DOCS):
                b = big.slice(a, DOCS)
                got = found.find([normal(x.as_py()) for x in b.column(at)])
                yield b.filter(pa.array([not m for m in got], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
