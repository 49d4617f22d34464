"""Interpolated modified Kneser-Ney bigram models, counted in Spark and kept as sorted hash arrays.

Words are counted first; a word's number is its place among the sorted word hashes. Bigrams are then counted as 64-bit
keys (previous word's number, word's number) in shards of sorted arrays, from which each word's continuations follow.
All arrays are plain files in the shared folder; workers map them into memory and merge-join the sorted keys of a batch
of documents with each shard, so that no task holds more than a batch and the pages it touches. Or the batches' keys are
sent to the shards and the counts back (``asked``), so that each shard is read once.

Counting combines in each task before the shuffle. A shard holds a range of previous words, but for words so frequent
that they would fill one: their bigrams are dealt to all shards by the second word.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import release, scratch, tidy, unused

#: No word can hold white space, so these are free.
END, BEGIN = (xxhash.xxh64_intdigest(x, 42) for x in (b"\n", b" "))
#: Tokens that a task holds before it combines them, and distinct keys before it hands them on.
BATCH_TOKENS, BUFFER_KEYS = 400_000, 2_000_000
#: Tokens of a batch that asks the shards for counts.
ASK_TOKENS = 1_200_000
VOCAB_BYTES, PAIR_BYTES = 48_000_000, 12_000_000
#: Arrays that a worker maps at once, and bytes of them that it holds where they can't be mapped.
HELD, HELD_BYTES = 1024, 256 << 20
#: Files that a worker keeps open to read parts of them.
OPEN = 128


class Store:
    """Arrays by name in the shared folder: mapped where it is a mounted one, and else fetched into memory. A worker holds
    the last ``HELD`` of them, or as many as ``HELD_BYTES`` of fetched ones; others are given back."""

    def __init__(self, uri: str):
        self.uri = uri
        parts = urlparse(uri)
        self.local = parts.path if parts.scheme in ("", "file") else None
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()
        self.open: OrderedDict[str, tuple] = OrderedDict()

    def __getstate__(self):
        return {"uri": self.uri, "local": self.local, "held": OrderedDict(), "open": OrderedDict()}

    def save(self, name: str, x: np.ndarray) -> None:
        """Whole or not at all: a task that runs twice writes the same file twice."""
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                np.save(f, x)
            os.replace(part, f"{self.local}/{name}.npy")
            return
        files, path = pafs.FileSystem.from_uri(self.uri)
        files.create_dir(path, recursive=True)
        data = io.BytesIO()
        np.save(data, x)
        with files.open_output_stream(f"{path}/{name}.npy") as out:
            out.write(data.getbuffer())

    def load(self, name: str) -> np.ndarray:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        if self.local is None:
            files, base = pafs.FileSystem.from_uri(self.uri)
            with files.open_input_stream(f"{base}/{name}.npy") as f:
                found = np.load(io.BytesIO(f.read()))
            spare = HELD_BYTES - found.nbytes
            while self.held and sum(x.nbytes for x in self.held.values()) > spare:
                self.held.popitem(last=False)
        else:
            path = f"{self.local}/{name}.npy"
            found = np.load(path, mmap_mode="r").view(np.ndarray) if os.path.getsize(path) > 128 else np.load(path)
        self.held[name] = found
        if len(self.held) > HELD:
            self.held.popitem(last=False)
        return found

    def part(self, name: str, begin: int, end: int) -> np.ndarray:
        """An array's elements from begin to end, read and not mapped: pages that a map once touched stay the worker's, so
        that one that reads here and there soon has all files."""
        if self.local is None:
            return self.load(name)[begin:end].copy()
        if name not in self.open:
            f = open(f"{self.local}/{name}.npy", "rb", buffering=0)  # noqa: SIM115
            np.lib.format.read_magic(f)
            kind = np.lib.format.read_array_header_1_0(f)[2]
            self.open[name] = f, f.tell(), kind
            if len(self.open) > OPEN:
                self.open.popitem(last=False)[1][0].close()
        self.open.move_to_end(name)
        f, at, kind = self.open[name]
        size = (end - begin) * kind.itemsize
        if len(data := os.pread(f.fileno(), size, at + begin * kind.itemsize)) != size:
            raise OSError(f"{name} ends before element {end}")
        return np.frombuffer(data, kind)


class _Hashes(dict):
    """Word -> XXH64; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


def hashed(text: str | None, hashes: _Hashes) -> np.ndarray:
    """The tokens of a whole text: words of its A-Z lower-cased form, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.full(len(words) + 1, END, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return out


def _groups(batches: Iterator[pa.RecordBatch], column: int, hashes: _Hashes, tokens: int = BATCH_TOKENS) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches of about so many tokens, and their documents' tokens."""
    for b in batches:
        begin, docs, n = 0, [], 0
        for i in range(b.num_rows):
            docs.append(hashed(b.column(column)[i].as_py(), hashes))
            n += len(docs[-1])
            if n >= tokens:
                yield b.slice(begin, i + 1 - begin), docs
                begin, docs, n = i + 1, [], 0
        if docs:
            yield b.slice(begin, len(docs)), docs


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts' sums."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order].astype(np.int64)
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[heads], np.add.reduceat(c, heads) if len(k) else c


def _shrunk(data: bytes) -> bytes:
    """Compressed for a shuffle: entropy coding, which the shuffle's own compressor lacks, takes a quarter off."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _pack(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte plane by byte plane, compressed."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0))
    return _shrunk(np.ascontiguousarray(gaps.view(np.uint8).reshape(len(keys), -1).T).tobytes())


def _unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_grown(data), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


class _Counter:
    """Counts keys within a task, in bounded memory, and yields rows (part, size, keys, counts) for a shuffle."""

    def __init__(self, part_of):
        self.part_of, self.keys, self.counts, self.n = part_of, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.n += len(k)
        if self.n >= BUFFER_KEYS:
            k, c = _sum(self.keys, self.counts)
            self.keys, self.counts, self.n = [k], [c], len(k)
            if self.n >= BUFFER_KEYS // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        k, c = _sum(self.keys, self.counts)
        self.keys, self.counts, self.n = [], [], 0
        part = self.part_of(k)
        order = np.argsort(part, kind="stable")
        part, k, c = part[order], k[order], c[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for at in range(0, len(cuts) - 1, 64):
            rows = [(int(part[a]), _pack(k[a:b]), (s := _small(c[a:b])).itemsize, s.tobytes()) for a, b in zip(cuts[at : at + 64], cuts[at + 1 : at + 65])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())], ["part", "keys", "width", "counts"])


COUNTED = "part int, keys binary, width int, counts binary"


def _gather(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all rows of one part; merged as they come, so that no more than the part is held twice."""
    keys, counts = [], []
    for k, w, c in zip(t["keys"], t["width"].to_pylist(), t["counts"]):
        keys.append(_unpack(k.as_py()))
        counts.append(np.frombuffer(c.as_py(), f"u{w}"))
    return _sum(keys, counts)


@dataclass
class Model:
    """What workers need to find the arrays."""

    store: Store
    bits: int  # of a word hash that choose its vocabulary file
    offsets: np.ndarray  # the first word number of each file, then the number of words V
    shards: int
    tokens: int  # N
    docs: int
    hot: np.ndarray  # numbers of the words whose bigrams are dealt to all shards
    discount: np.ndarray | None = None  # of bigrams seen once, twice, more
    lower: np.ndarray | None = None  # of words that follow one, two, more words
    pairs: int = 0  # distinct bigrams
    filled: np.ndarray | None = None  # shards that hold any

    @property
    def vocabulary(self) -> int:
        return int(self.offsets[-1])

    def number(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of sorted distinct hashes; V + 1 for unknown words, V for the beginning."""
        out = np.full(len(h), self.vocabulary + 1, np.int64)
        cuts = np.searchsorted(h >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(h), np.uint64), np.arange(len(self.offsets)))
        for s in range(len(self.offsets) - 1):
            part = h[cuts[s] : cuts[s + 1]]
            if len(part) and self.offsets[s + 1] > self.offsets[s]:
                keys = self.store.load(f"word-{s}")
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                out[cuts[s] : cuts[s + 1]] = np.where(keys[at] == part, at + self.offsets[s], self.vocabulary + 1)
        out[h == np.uint64(BEGIN)] = self.vocabulary
        return out

    def values(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A word array's values for sorted distinct numbers below V."""
        cuts = np.searchsorted(ids, self.offsets)
        found = [self.store.load(f"{name}-{s}")[ids[a:b] - self.offsets[s]] for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return np.concatenate(found) if found else np.zeros((0, 3) if name == "kinds" else 0, np.int64)

    def part(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each bigram."""
        u, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        v = self.vocabulary + 1
        out = u * self.shards // v
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            out = np.where(self.hot[at] == u, w * self.shards // v, out)
        return out

    def score(self, docs: list[np.ndarray], answers: Answers | None = None) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of whole documents, logarithms to base 10; with the bigrams' counts
        out of ``answers``, where this batch's are there."""
        sizes = np.array([len(d) for d in docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        words, back = np.unique(np.concatenate([*docs, np.array([BEGIN], np.uint64)]), return_inverse=True)
        ids = self.number(words)
        v = self.vocabulary
        order = np.argsort(ids, kind="stable")
        known = ids[order][ids[order] < v]
        count, follows = np.zeros(len(words)), np.zeros(len(words))
        kinds = np.zeros((len(words), 3))
        at = order[: len(known)]
        count[at], follows[at], kinds[at] = self.values("count", known), self.values("follows", known), self.values("kinds", known)
        begin = ids == v
        if begin.any() and self.tokens:
            count[begin], kinds[begin] = self.docs, self.store.load("begin-kinds")
        w = back[:-1]
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[starts] = back[-1]
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (v + 1)))
        if not self.tokens:  # nothing learned: every token is as likely as the unknown one
            score = np.zeros(len(words))[w]
        else:
            d = np.r_[0, self.lower]
            total = max(self.pairs, 1)
            spare = float((d[1:] * self.store.load("lower-kinds")).sum()) / total
            lower = np.maximum(follows - d[np.minimum(follows, 3).astype(int)], 0) / total + spare / (v + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                gamma = np.where(count > 0, kinds @ self.discount / count, 1.0)
            pairs = self._pairs(ids[u], ids[w], answers)
            cu = np.maximum(count[u], 1)
            high = np.maximum(pairs - np.r_[0, self.discount][np.minimum(pairs, 3)], 0) / cu
            score = np.log10(high + gamma[u] * lower[w])
        sums = lambda x: np.add.reduceat(x, starts) if len(x) else x
        return sizes, sums((count[w] > 0).astype(np.int64)), sums(base[w]), sums(score)

    def keys(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of bigrams by their words' numbers: which may be known, their distinct keys, and which key each has."""
        at = np.flatnonzero((u <= self.vocabulary) & (w < self.vocabulary))
        return at, *np.unique(u[at].astype(np.uint64) << np.uint64(32) | w[at].astype(np.uint64), return_inverse=True)

    def by_shard(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the keys by shard, and where each shard begins in it."""
        part = self.part(keys)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(self.shards + 1))

    def counts(self, shard: int, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted bigrams of one shard: a merge join."""
        if not len(keys) or not self.filled[shard]:
            return np.zeros(len(keys), np.int64)
        have, n = self.store.load(f"pair-{shard}"), self.store.load(f"pair-count-{shard}")
        i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[i] == keys, n[i], 0).astype(np.int64)

    def _pairs(self, u: np.ndarray, w: np.ndarray, answers: Answers | None = None) -> np.ndarray:
        out = np.zeros(len(u), np.int64)
        at, keys, back = self.keys(u, w)
        order, cuts = self.by_shard(keys)
        found = np.zeros(len(keys), np.int64)
        if (n := answers.find(keys) if answers else None) is not None:
            found[order] = n
        else:
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                found[order[cuts[s] : cuts[s + 1]]] = self.counts(s, keys[order[cuts[s] : cuts[s + 1]]])
        out[at] = found[back]
        return out


def _discounts(kinds: np.ndarray) -> np.ndarray:
    """The three discounts from how many were seen once to four times; each from 0 to what it is taken from."""
    n1, n2, n3, n4 = (float(x) for x in kinds)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, [0.05, 0.1, 0.1], [0.95, 1.9, 2.9])


def _kinds(counts: np.ndarray, n: int) -> np.ndarray:
    return np.array([(counts == i + 1).sum() for i in range(n)], np.int64)


def train(docs: DataFrame, name: str = "kneser-ney", text: str = "text") -> Model:
    """Counts every whole text of docs (null: empty). No rows: a model under which nothing is known."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).cast("string").alias("text"))
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(2, int(np.ceil(np.log2(max(1, size / VOCAB_BYTES)))))
    shards = max(8, -(-int(size) // PAIR_BYTES))
    # words as frequent as this could fill a shard; there are some a shard of them at most, as they share the tokens
    often = PAIR_BYTES // 48
    store = Store(scratch(spark, name))
    model = Model(store, bits, np.zeros(2**bits + 1, np.int64), shards, 0, int(rows), np.zeros(0, np.int64))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counter = _Hashes(), _Counter(lambda k: (k >> np.uint64(64 - bits)).astype(np.int64))
        for _, got in _groups(batches, 0, hashes):
            yield from counter.add(np.concatenate(got))
        yield from counter.flush()

    def vocabulary(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        k, c = _gather(t)
        store.save(f"word-{part}", k)
        store.save(f"count-{part}", c)
        return pa.table({"part": pa.array([part], pa.int32()), "words": pa.array([len(k)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64()), "hot": pa.array([np.flatnonzero(c > often).tolist()], pa.list_(pa.int64()))})

    found = texts.mapInArrow(tidy(words), COUNTED).groupBy("part").applyInArrow(vocabulary, "part int, words long, tokens long, hot array<long>").collect()
    sizes = np.zeros(2**bits, np.int64)
    for r in found:
        sizes[r.part] = r.words
        model.tokens += r.tokens
    model.offsets = np.r_[0, np.cumsum(sizes)]
    if model.vocabulary >= 2**32 - 2:
        raise ValueError("over 2**32 - 2 distinct words")
    hot = [np.array(r.hot, np.int64) + model.offsets[r.part] for r in found]
    model.hot = np.sort(np.r_[np.concatenate([*hot, np.zeros(0, np.int64)]).astype(np.int64), model.vocabulary])  # the beginning too
    if not model.tokens:
        model.discount = model.lower = np.array([0.5, 1.0, 1.5])
        return model
    store.held.clear()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counter = _Hashes(), _Counter(model.part)
        for _, got in _groups(batches, 0, hashes):
            sizes = np.array([len(d) for d in got])
            distinct, back = np.unique(np.concatenate(got), return_inverse=True)
            w = model.number(distinct)[back].astype(np.uint64)
            u = np.empty_like(w)
            u[1:] = w[:-1]
            u[np.cumsum(sizes) - sizes] = model.vocabulary
            yield from counter.add(u << np.uint64(32) | w)
        yield from counter.flush()

    def shard(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        k, c = _gather(t)
        store.save(f"pair-{part}", k)
        store.save(f"pair-count-{part}", _small(c))
        u, w = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = []
        heads = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        # a frequent word's bigrams are sorted by it in every shard, so its kinds are partial sums here
        kinds = np.stack([np.add.reduceat((np.minimum(c, 3) == i).astype(np.int64), heads) for i in (1, 2, 3)], 1)
        v, n = np.unique(w, return_counts=True)
        for what, ids, values in (("kinds", u[heads], kinds), ("follows", v, n)):
            cuts = np.searchsorted(ids, model.offsets)
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    small = _small(values[a:b])
                    out.append((s, what, _pack(ids[a:b].astype(np.uint64)), small.itemsize, small.tobytes(), None))
        begin = np.flatnonzero(u[heads] == model.vocabulary)
        out.append((-1, "shard", b"", part, b"", [len(k), *_kinds(c, 4).tolist(), *(kinds[begin].sum(axis=0).tolist())]))
        return pa.table(dict(zip(("part", "what", "keys", "width", "counts", "sums"), map(pa.array, zip(*out), (pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))))))

    stats = texts.mapInArrow(tidy(pairs), COUNTED).groupBy("part").applyInArrow(shard, "part int, what string, keys binary, width int, counts binary, sums array<long>")

    def finish(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        if part < 0:
            return pa.table({"part": pa.array([part], pa.int32()), "sums": pa.array([[*np.sum(t["sums"].to_pylist(), axis=0).tolist(), *t["width"].to_pylist()]], pa.list_(pa.int64()))})
        n = int(model.offsets[part + 1] - model.offsets[part])
        follows, kinds = np.zeros(n, np.int64), np.zeros((n, 3), np.int64)
        for what, k, width, c in zip(t["what"].to_pylist(), t["keys"], t["width"].to_pylist(), t["counts"]):
            ids = _unpack(k.as_py()).astype(np.int64) - model.offsets[part]
            c = np.frombuffer(c.as_py(), f"u{width}")
            if what == "kinds":
                kinds[ids] += c.reshape(-1, 3).astype(np.int64)
            else:
                follows[ids] += c.astype(np.int64)
        store.save(f"follows-{part}", _small(follows))
        store.save(f"kinds-{part}", _small(kinds))
        return pa.table({"part": pa.array([part], pa.int32()), "sums": pa.array([[*_kinds(follows, 4).tolist(), int((follows > 2).sum())]], pa.list_(pa.int64()))})

    ended = stats.groupBy("part").applyInArrow(finish, "part int, sums array<long>").collect()
    whole = next(r.sums for r in ended if r.part < 0)
    lower = np.sum([r.sums for r in ended if r.part >= 0], axis=0)
    model.pairs, model.discount, model.lower = int(whole[0]), _discounts(whole[1:5]), _discounts(lower[:4])
    model.filled = np.isin(np.arange(shards), whole[8:])
    store.save("begin-kinds", np.array(whole[5:8], np.int64))
    store.save("lower-kinds", np.array([lower[0], lower[1], lower[4]], np.int64))
    store.save("meta", np.frombuffer(json.dumps({"tokens": model.tokens, "vocabulary": model.vocabulary, "pairs": model.pairs}).encode(), np.uint8))
    store.held.clear()
    del stats, ended, found
    release(spark)
    return model


@dataclass
class Answers:
    """The counts that batches of documents asked of the shards, by a hash of the keys that each asked for: in their order
    by shard. They lie in files of some batches each."""

    store: Store
    bits: int

    def file(self, batch: int) -> int:
        return batch % 2**64 >> 64 - self.bits if self.bits else 0

    def find(self, keys: np.ndarray) -> np.ndarray | None:
        """The counts; nothing if no batch asked for just these keys, as where files are split otherwise than before."""
        name = batch_name(keys)
        file = self.file(name)
        try:
            held, ends = self.store.load(f"asked-{file}"), self.store.load(f"ends-{file}")
        except FileNotFoundError:
            return None
        i = int(np.searchsorted(held, name))
        if i == len(held) or held[i] != name:
            return None
        packed = self.store.load(f"counts-{file}")[ends[i - 1] if i else 0 : ends[i]]
        n = np.frombuffer(_grown(packed[1:].tobytes()), f"u{packed[0]}")
        return n if len(n) == len(keys) else None


def batch_name(keys: np.ndarray) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(keys).view(np.uint8)) - 2**63


def asked(rows: DataFrame, column: int, model: Model, tokens: int) -> Answers | None:
    """Joins the bigrams of all batches of rows with the shards: each batch's distinct bigrams go to the shards that hold
    them, a shard is read once for all that ask, and the counts come back by batch."""
    if not model.tokens:
        return None
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)  # offsets and the frequent words: some numbers a shard
    answers = Answers(Store(scratch(spark, "answers")), max(0, ceil(log2(max(1, tokens / ASK_TOKENS / 8)))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = _Hashes(), shared.value
        for _, got in _groups(batches, column, hashes, ASK_TOKENS):
            words, back = np.unique(np.concatenate([*got, np.array([BEGIN], np.uint64)]), return_inverse=True)
            ids = model.number(words)
            u = np.r_[back[-1], back[:-2]]
            u[np.cumsum([0, *map(len, got[:-1])])] = back[-1]
            _, keys, _ = model.keys(ids[u], ids[back[:-1]])
            if not len(keys):
                continue
            name, (order, cuts) = batch_name(keys), model.by_shard(keys)
            some = np.flatnonzero(np.diff(cuts)).tolist()
            packed = [_pack(keys[order[cuts[s] : cuts[s + 1]]]) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([name] * len(some), pa.int64()), pa.array(packed, pa.binary())], ["shard", "batch", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, widths, out = [], [], []
            for s, name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n = _small(shared.value.counts(s, _unpack(k.as_py())))
                files.append(answers.file(name))
                widths.append(n.itemsize)
                out.append(_shrunk(n.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), b.column(1), b.column(0), pa.array(widths, pa.int32()), pa.array(out, pa.binary())], ["file", "batch", "shard", "width", "counts"])

    def save(t: pa.Table) -> pa.Table:
        found: dict[int, dict[int, np.ndarray]] = {}
        for name, s, width, n in zip(t["batch"].to_pylist(), t["shard"].to_pylist(), t["width"].to_pylist(), t["counts"]):
            found.setdefault(name, {})[s] = np.frombuffer(_grown(n.as_py()), f"u{width}")  # batches of equal keys are one
        file, names = t["file"][0].as_py(), sorted(found)
        parts = [np.concatenate([found[x][s] for s in sorted(found[x])]) for x in names]
        packed = [bytes([x.itemsize]) + _shrunk(x.tobytes()) for x in parts]
        answers.store.save(f"ends-{file}", np.cumsum([len(x) for x in packed]))
        answers.store.save(f"counts-{file}", np.frombuffer(b"".join(packed), np.uint8))
        answers.store.save(f"asked-{file}", np.array(names, np.int64))
        return pa.table({"file": pa.array([file], pa.int64())})

    parts = max(model.shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(tidy(ask), "shard int, batch long, keys binary").repartition(parts, "shard").sortWithinPartitions("shard")
    counted = dealt.mapInArrow(tidy(answer), "file long, batch long, shard int, width int, counts binary")
    counted.groupBy("file").applyInArrow(save, "file long").agg(F.count(F.lit(1))).first()
    del dealt, counted
    release(spark)
    return answers


#: Shards (of some 12 MB of text each) that every worker maps without harm.
MAPPED_SHARDS = 8


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", join: bool | None = False) -> DataFrame:
    """The columns ``keep`` of docs with n_tokens, n_known, base_score and score of every whole text (null: empty).

    Each batch of documents looks its bigrams up in the shards, which workers map. With ``join`` documents are read twice:
    first all batches ask the shards for counts (see ``asked``), then these are put together; a batch that finds no answer
    looks its bigrams up itself, to the same result. None: with it where the model has more than MAPPED_SHARDS, so that
    a small one, all of which a worker holds, spares the second reading."""
    join = model.shards > MAPPED_SHARDS if join is None else join
    kind = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", n_tokens long, n_known long, base_score double, score double"
    rows = docs.select(*keep, F.col(text).cast("string").alias(*unused(keep, "text")))
    answers, tokens = None, BATCH_TOKENS
    if join:
        size = rows.agg(F.coalesce(F.sum(F.octet_length(rows.columns[-1])), F.lit(0))).first()[0]
        answers, tokens = asked(rows, len(keep), model, int(size) // 6), ASK_TOKENS
    shared = docs.sparkSession.sparkContext.broadcast(model)  # offsets and the frequent words: some numbers a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b, got in _groups(batches, len(keep), hashes, tokens):
            n, known, base, full = shared.value.score(got, answers)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n), pa.array(known), pa.array(base), pa.array(full)], [*keep, "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(tidy(run), kind)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a model of the documents whose
    crc32(doc_id as text) mod 10 is not 0 (a null doc_id counts as the text '') scores every document. Batches ask the
    shards for counts, so that each shard is read once however many documents there are.

    Empty texts are their end alone. Repeated rows are learned from and answered one by one. If nothing is learned
    from, score is 0 and base_score goes by its formula.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0).alias("held_out"))
    model = train(marked.where(~F.col("held_out")))
    found = score(marked, model, ["doc_id", "held_out"], join=None)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
