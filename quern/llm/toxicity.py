"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A token is the sum of hashed embeddings of the word and of its first four and six characters. Filters of several
widths slide over the whole text; each keeps its largest response, and a logistic layer weighs these. Score inputs are
the text alone. All labelled rows are learned from, in shards that train side by side and are averaged after each round.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, release, tidy
from quern.plans.models import sized

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
UNITS, PAD = 3, max(WIDTHS)
#: Rows of either class, about, that one task fits on: there are as many shards as all rows need.
MAX_FIT_ROWS = 2500
#: Calibrated scores that one task sorts, about.
MAX_CALIBRATION_ROWS = 4000
#: Bytes of text, about, of half a shard.
MAX_FIT_BYTES = 32 << 20
#: Words that one step of fitting looks at, about; a longer text is one step of its own, in blocks.
STEP_WORDS = 1 << 16
#: Buckets of one block of the embeddings, as they are averaged.
BLOCK = 512
PREDICT_AT = 0.3


class _Ids(dict):
    """Word -> its bucket numbers as one packed integer; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        w = word.decode("utf-8", "surrogatepass").lower().strip(".,;:!?\"'()[]")
        out = 0
        for i, unit in enumerate((w, "4" + w[:4], "6" + w[:6])):
            out |= (1 + xxhash.xxh32_intdigest(unit.encode("utf-8", "surrogatepass"), i) % (BUCKETS - 1)) << (20 * i)
        self[word] = out
        return out


def tokens(text: str | None, ids: _Ids) -> np.ndarray:
    """(words, UNITS) bucket numbers of the whole text, padded by PAD zero rows; bucket 0 stays a zero vector."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    packed = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    out = np.zeros((len(words) + PAD, UNITS), np.int32)
    for i in range(UNITS):
        out[: len(words), i] = packed >> (20 * i) & 0xFFFFF
    return out


@dataclass
class Net:
    emb: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of the logit
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @staticmethod
    def new(seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        emb[0] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Net(emb, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def responses(self, ids: np.ndarray) -> list[np.ndarray]:
        """What each width's filters answer at each position."""
        x = self.emb[ids[:, 0]]
        for i in range(1, UNITS):
            x = x + self.emb[ids[:, i]]
        out = []
        for w, b in zip(self.filters, self.bias):
            n = len(x) - len(w) + 1
            r = x[:n] @ w[0]
            for j in range(1, len(w)):
                r += x[j : n + j] @ w[j]
            out.append(r + b)
        return out

    def logit(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of whole documents; long ones in blocks that overlap by the widest filter, whose maxima are joined."""
        best = np.full((len(docs), len(self.out)), -np.inf, np.float32)
        at, step = 0, 1 << 16
        while at < len(docs):
            group, size = [], 0
            while at + len(group) < len(docs) and (not group or size + len(docs[at + len(group)]) <= step):
                size += len(docs[at + len(group)])
                group.append(docs[at + len(group)])
            if len(group) == 1 and size > step:
                for a in range(0, size, step):
                    got = np.concatenate([r.max(axis=0) for r in self.responses(group[0][a : a + step + PAD]) if len(r)])
                    best[at, : len(got)] = np.maximum(best[at, : len(got)], got)
            else:
                starts = np.cumsum([0, *map(len, group[:-1])])
                flat = self.responses(np.concatenate(group))
                for k, r in enumerate(flat):
                    for j in range(1, WIDTHS[k]):  # no place reaches into the next document
                        r[starts[1:] - j] = -np.inf
                    best[at : at + len(group), k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(r, starts, axis=0)
            at += len(group)
        return np.maximum(best, 0) @ self.out + self.out_bias

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        z = self.scale[0] * self.logit(docs).astype(float) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _seen(rows: Iterable[tuple[np.ndarray, float]]) -> np.ndarray:
    """(2, BUCKETS + 1): in how many rows of each class a bucket stands, and at the end the rows."""
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for d, label in rows:
        seen[int(label), np.unique(d)] += 1
        seen[int(label), BUCKETS] += 1
    return seen


def _warm(net: Net, seen: np.ndarray) -> None:
    """Starts the first dimension at how surely a bucket's presence tells the classes apart, and filter 0 at reading it."""
    seen, n = seen[:, :BUCKETS], np.maximum(1, seen[:, BUCKETS:])
    rate = np.log((seen + 0.5) / (n + 1))
    sure = (rate[1] - rate[0]) / np.sqrt((1 / (seen + 0.5)).sum(axis=0))
    net.emb[:, 0] = np.clip(sure / 3, -1, 2)
    net.emb[0] = 0
    for w, b in zip(net.filters, net.bias):
        w[:, :, 0] = 0
        w[:, 0, 0] = 1 / len(w)
        b[0] = -0.5
    net.out[::FILTERS] = 1.0


def _sums(net: Net) -> dict:
    """Adagrad's sums of squares, as they begin."""
    return {"emb": np.full(BUCKETS, 1e-2, np.float32), "out": np.full(net.out.shape, 1e-2, np.float32), "f": [np.full(w.shape, 1e-2, np.float32) for w in net.filters], "b": [np.full(b.shape, 1e-2, np.float32) for b in net.bias], "ob": 1e-2}


def _start(seen: np.ndarray, seed: int) -> tuple[Net, float | None]:
    """The net before its first round and the weight of toxic rows; None where there aren't both classes to learn from."""
    net, (n0, n1) = Net.new(seed), seen[:, BUCKETS]
    if not n0 or not n1:
        net.out_bias = 0.0 if not n0 + n1 else 6.0 * (1 if n1 else -1)
        net.out[:] = 0
        net.threshold = 0.5 if n0 + n1 else 1.01
        return net, None
    _warm(net, seen)
    return net, float(np.clip(n0 / n1, 1, 10))


def _peaks(net: Net, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Each text's largest response to each filter, and by width the place that gave it in the texts laid end to end."""
    flat = np.concatenate(docs) if len(docs) > 1 else docs[0]
    starts = np.cumsum([0, *map(len, docs)])
    pooled, where = [], []
    if len(flat) <= 2 * STEP_WORDS or len(docs) > 1:
        for w, r in zip(net.filters, net.responses(flat)):
            best = np.array([a + r[a : b - len(w) + 1].argmax(axis=0) for a, b in zip(starts, starts[1:])])
            where.append(best)
            pooled.append(np.take_along_axis(r, best, axis=0))
        return np.concatenate(pooled, axis=1), where, flat
    pooled = [np.full((1, FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    where = [np.zeros((1, FILTERS), np.int64) for _ in WIDTHS]
    for a in range(0, len(flat) - PAD + 1, STEP_WORDS):
        for k, r in enumerate(net.responses(flat[a : a + STEP_WORDS + WIDTHS[-1] - 1])):
            top = r.argmax(axis=0)
            high = np.take_along_axis(r, top[None], axis=0)
            where[k] = np.where(high > pooled[k], a + top, where[k])
            pooled[k] = np.maximum(high, pooled[k])
    return np.concatenate(pooled, axis=1), where, flat


def _learn(net: Net, sums: dict, docs: list[np.ndarray], y: np.ndarray, toxic_weight: float, rate: float) -> np.ndarray:
    """One step of Adagrad on the log loss; only the places that gave a filter's maximum learn. The buckets that moved."""
    h, where, flat = _peaks(net, docs)
    hot = h > 0
    z = np.maximum(h, 0) @ net.out + net.out_bias
    g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, toxic_weight, 1.0) / len(docs)).astype(np.float32)
    dout = np.maximum(h, 0).T @ g
    dh = np.where(hot, g[:, None] * net.out, 0).astype(np.float32)
    ids, grads = [], []
    for k, w in enumerate(net.filters):
        d = dh[:, k * FILTERS : (k + 1) * FILTERS]
        dw = np.empty_like(w)
        for j in range(len(w)):
            x = net.emb[flat[where[k] + j]].sum(axis=2)  # docs, filters, dim
            dw[j] = np.einsum("df,dfe->ef", d, x)
            dx = (d[:, :, None] * w[j].T[None]).reshape(-1, DIM)
            ids.append(flat[where[k] + j].reshape(-1, UNITS))
            grads.append(dx)
        sums["f"][k] += dw**2
        w -= rate * dw / np.sqrt(sums["f"][k])
        db = d.sum(axis=0)
        sums["b"][k] += db**2
        net.bias[k] -= rate * db / np.sqrt(sums["b"][k])
    sums["out"] += dout**2
    net.out -= rate * dout / np.sqrt(sums["out"])
    sums["ob"] += float(g.sum()) ** 2
    net.out_bias -= float(rate * g.sum() / np.sqrt(sums["ob"]))
    i, dx = np.concatenate(ids), np.concatenate(grads)
    for u in range(UNITS):
        which, at_ = np.unique(i[:, u], return_inverse=True)
        total = np.zeros((len(which), DIM), np.float32)
        np.add.at(total, at_, dx)
        sums["emb"][which] += (total**2).mean(axis=1)
        net.emb[which] -= rate * total / np.sqrt(sums["emb"][which])[:, None]
    net.emb[0] = 0
    return np.unique(i)


def _round(net: Net, sums: dict, rows: Iterable[tuple[np.ndarray, float]], toxic_weight: float, batch: int = 16, rate: float = 0.05) -> tuple[int, np.ndarray]:
    """Learns from rows (ids, label) as they come, once. How many they were, and in how many steps a bucket moved."""
    n, moved, docs, y, size = 0, np.zeros(BUCKETS), [], [], 0

    def step() -> None:
        if docs:
            moved[_learn(net, sums, docs, np.array(y), toxic_weight, rate)] += 1
            docs.clear(), y.clear()

    for d, label in rows:
        if len(docs) == batch or size + len(d) > STEP_WORDS:
            step()
            size = 0
        docs.append(d), y.append(label)
        n, size = n + 1, size + len(d)
    step()
    return n, moved


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.05, seed: int = 7) -> Net:
    """The net of rows that one task holds: the same rounds as those of ``train``, over one shard."""
    net, toxic_weight = _start(_seen(zip(docs, y)), seed)
    if toxic_weight is None:
        return net
    sums, rng = _sums(net), np.random.default_rng(seed)
    for _ in range(epochs):
        _round(net, sums, ((docs[i], float(y[i])) for i in rng.permutation(len(docs))), toxic_weight, batch, rate)
    return net


def _dense(net: Net, sums: dict) -> list[np.ndarray]:
    return [*net.filters, *net.bias, net.out, np.array([net.out_bias]), *sums["f"], *sums["b"], sums["out"], np.array([sums["ob"]])]


def _packed(net: Net, sums: dict, n: int, moved: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(block, weights, values): the embeddings in blocks, of the buckets that moved alone, each weighed by its steps, and
    the rest by the rows."""
    out = []
    for i, w in enumerate(moved.reshape(-1, BLOCK)):
        if (w > 0).any():
            at = i * BLOCK + np.flatnonzero(w)
            out.append((i, w.tobytes(), np.concatenate([net.emb[at], sums["emb"][at, None]], axis=1).astype(np.float32).tobytes()))
    return [*out, (BUCKETS // BLOCK, np.array([float(n)]).tobytes(), np.concatenate([x.ravel() for x in _dense(net, sums)]).astype(np.float32).tobytes())]


def _unpacked(net: Net, sums: dict, blocks: dict[int, tuple[bytes, bytes]]) -> None:
    """Takes averaged blocks into the net; a bucket that no shard moved stays."""
    for i, (weight, value) in blocks.items():
        if i < BUCKETS // BLOCK:
            at = i * BLOCK + np.flatnonzero(np.frombuffer(weight) > 0)
            value = np.frombuffer(value).reshape(len(at), DIM + 1)
            net.emb[at], sums["emb"][at] = value[:, :DIM], value[:, DIM]
    value, start, dense = np.frombuffer(blocks[BUCKETS // BLOCK][1]), 0, _dense(net, sums)
    for x in dense:
        x[...] = value[start : start + x.size].reshape(x.shape)
        start += x.size
    net.out_bias, sums["ob"] = float(dense[2 * len(WIDTHS) + 1][0]), float(dense[-1][0])


def _averaged(group: pa.Table) -> pa.Table:
    """Of one block: the shards' values, averaged by their weights, summed in the shards' order."""
    rows = sorted(group.to_pylist(), key=lambda r: r["shard"])
    total = sum(np.frombuffer(r["weight"]) for r in rows)
    value = None
    for r in rows:
        w = np.frombuffer(r["weight"])
        v = np.frombuffer(r["value"], np.float32).reshape((w > 0).sum(), -1)
        value = np.zeros((len(w), v.shape[1])) if value is None else value
        value[w > 0] += w[w > 0, None] * v
    value = value[total > 0] / total[total > 0, None]
    return pa.table({"block": pa.array([rows[0]["block"]], pa.int32()), "weight": pa.array([total.tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary())})


def _counted(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in group.column("value").to_pylist())
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "value": pa.array([total.tobytes()], pa.binary())})


_P = "1D / (1D + exp(-greatest(-30D, least(30D, {a!r}D * z + {b!r}D))))"


def _scale(held: DataFrame, n0: int, n1: int) -> tuple[float, float]:
    """The logit's scale and shift by Newton's steps on the log loss of all rows (z, y): each step is one sum over them."""
    a, b = 1.0, 0.0
    for _ in range(50):
        rows = held.selectExpr("z", f"{_P.format(a=a, b=b)} AS p", f"CASE WHEN y = 1 THEN {(n1 + 1) / (n1 + 2)!r}D ELSE {1 / (n0 + 2)!r}D END AS t").selectExpr("z", "p - t AS d", "p * (1D - p) + 1E-9D AS w")
        g0, g1, h00, h01, h11 = rows.selectExpr("sum(d * z)", "sum(d)", "sum(w * z * z)", "sum(w * z)", "sum(w)").first()  # total: an aggregate is one row
        step = np.linalg.solve(np.array([[h00 + 1e-3, h01], [h01, h11]]), np.array([g0 + 1e-3 * (a - 1), g1]))
        # a sum's last digits depend on the order of its parts
        a, b = (round(float(x), 9) for x in (a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def thresholds(scores: DataFrame, least: int = 20, limit: int = MAX_CALIBRATION_ROWS) -> dict[str | None, float]:
    """Of all rows (lang, p, y), under None, and of each language with ``least`` rows of either class: the threshold of the
    best F1, amid the gap that it falls into (see ``_best``). Scores are dealt out by ranges of about ``limit``, so that no
    task sorts a language."""
    names = ["whole", "lang"]
    both = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit("").alias("lang")), F.struct(F.lit(False).alias("whole"), F.col("lang"))))
    each = cut(scores.select(both.alias("g"), "p", "y").groupBy("g.whole", "g.lang", "p").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n")))
    wide = each.groupBy(*names).agg(F.sum("hits").alias("pos"), F.sum("n").alias("rows")).where(f"whole or least(pos, rows - pos) >= {least}").select(*names, "pos")
    ranges = -(-each.count() // limit) or 1
    dealt = cut(each.join(sized(cut(wide)), names).repartitionByRange(ranges, "whole", "lang", F.col("p").desc()).withColumn("r", F.spark_partition_id()))
    before = Window.partitionBy(*names).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy(*names, "r").agg(F.sum("hits").alias("h"), F.sum("n").alias("m")).select(*names, "r", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))
    upto = Window.partitionBy(*names, "r").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    f1 = dealt.withColumn("hits", F.sum("hits").over(upto)).withColumn("n", F.sum("n").over(upto)).join(sized(cut(starts)), [*names, "r"]).withColumn("f1", F.expr("2 * (hits + h) / (n + m + pos)"))
    best = cut(f1.groupBy(*names).agg(F.max(F.struct("f1", "p")).alias("best")).select(*names, F.col("best.p").alias("top")))
    found = dealt.join(sized(best), names).groupBy(*names, "top").agg(F.coalesce(F.max(F.when(F.col("p") < F.col("top"), F.col("p"))), F.lit(0.0)).alias("below")).collect()
    return {None if r.whole else r.lang: _amid(r.top, r.below) for r in found}


def _amid(top: float, below: float) -> float:
    logit = lambda x: np.log(np.clip(x, 1e-9, 1 - 1e-9) / (1 - np.clip(x, 1e-9, 1 - 1e-9)))
    return float(np.clip(1 / (1 + np.exp(-(logit(top) + logit(below)) / 2)), 0.05, 0.95))


def _best(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(p)) + 1 + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # a threshold can't part equal scores
    k = int(np.argmax(f1))
    return _amid(p[order][k], p[order][k + 1] if k + 1 < len(p) else 0.0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, max_calibration: int = MAX_CALIBRATION_ROWS, max_bytes: int = MAX_FIT_BYTES, epochs: int = 6, batch: int = 16, rate: float = 0.05, seed: int = 7) -> Net:
    """Fits on all labelled rows whose crc32(doc_id as text) mod 4 is not 2; a quarter of those calibrates. Equal rows count once.

    Rows are dealt out by their hash into shards of about ``max_rows`` of either class and ``max_bytes`` of text for each.
    In every round each shard's task goes on from the same net, in the order of the hashes, and the nets are averaged, block
    by block; a bucket's embedding by the steps in which it moved. The driver gets the averaged net, whose size is fixed.
    """
    c = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = sized(cut(known.where(c % 4 != 2).withColumn("part", F.when(F.shiftright(c, 2) % 4 == 0, F.lit(2)).otherwise(F.col("y")))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = ["doc_id", "t1", "t2", "lang"]
    rows = docs.where(F.col("doc_id").isNotNull() & (c % 4 != 2)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    rows = rows.join(known, "doc_id").select(*name, "text", "y", "part")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()  # total: an aggregate is one row
    shards = max(1, -(-n // (2 * max_rows)), -(-size // (2 * max_bytes)))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for b in batches:
            flat = [tokens(x.as_py(), ids).astype(np.int16).tobytes() for x in b.column(4)]  # a bucket takes 15 bits
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(flat, pa.binary()), b.column(5), b.column(6)], [*name, "ids", "y", "part"])

    kind = "doc_id long, t1 long, t2 long, lang string, ids binary, y int, part int"
    h = F.xxhash64("doc_id", "t1")
    held = cut(rows.mapInArrow(tidy(numbered), kind).repartition(shards, h).sortWithinPartitions(h, *name))

    def each(batches: Iterator[pa.RecordBatch], calibrating: bool) -> Iterator[tuple[np.ndarray, float, str]]:
        """(ids, label, language) of the different rows of a shard that are of the part asked for."""
        last = None
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            for i, (key, y, part) in enumerate(zip(names, b.column(5).to_pylist(), b.column(6).to_pylist())):
                if key != last and (part == 2) == calibrating:
                    yield np.frombuffer(b.column(4)[i].as_buffer(), np.int16).reshape(-1, UNITS), float(y), key[3]
                last = key

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _seen((d, y) for d, y, _ in each(batches, False))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([x.tobytes() for x in seen], pa.binary())], ["block", "value"])

    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for r in held.mapInArrow(tidy(counts), "block int, value binary").groupBy("block").applyInArrow(_counted, "block int, value binary").collect():
        seen[r.block] = np.frombuffer(r.value, np.int64)
    net, toxic_weight = _start(seen, seed)
    if toxic_weight is not None:
        sums = _sums(net)
        for _ in range(epochs):
            shared = docs.sparkSession.sparkContext.broadcast((net, sums))  # some 2 MB

            def rounds(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                own, squares = copy.deepcopy(shared.value)
                n, moved = _round(own, squares, ((d, y) for d, y, _ in each(batches, False)), toxic_weight, batch, rate)
                if n:
                    block, weight, value = zip(*_packed(own, squares, n, moved))
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(block), pa.int32()), pa.array(weight, pa.binary()), pa.array(value, pa.binary())], ["block", "shard", "weight", "value"])

            mean = held.mapInArrow(tidy(rounds), "block int, shard int, weight binary, value binary").groupBy("block").applyInArrow(_averaged, "block int, weight binary, value binary").collect()
            _unpacked(net, sums, {r.block: (r.weight, r.value) for r in mean})
            shared.destroy()
            release(docs.sparkSession)  # each round's shuffle

    shared = docs.sparkSession.sparkContext.broadcast(net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = each(batches, True)
        while some := list(itertools.islice(found, 16)):
            ids, y, lang = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(shared.value.logit(list(ids)).astype(float)), pa.array(list(map(int, y)), pa.int32())], ["lang", "z", "y"])

    found = cut(held.mapInArrow(tidy(logits), "lang string, z double, y int"))
    n, n1 = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()  # total: an aggregate is one row
    if 0 < n1 < n:  # one class only: the net stays as it is
        net.scale = _scale(found, n - n1, n1)
        net.thresholds = thresholds(found.selectExpr("lang", f"{_P.format(a=net.scale[0], b=net.scale[1])} AS p", "y"), limit=max_calibration)
        net.threshold = net.thresholds.pop(None)
    return net


def _scores(net: Net, texts: pa.Array, ids: _Ids) -> np.ndarray:
    out = [net.score([tokens(x.as_py(), ids) for x in texts.slice(at, 256)]) for at in range(0, len(texts), 256)]
    return np.concatenate(out) if out else np.zeros(0)


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score, threshold, toxic) of every document; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 2 MB: the net's size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, net = _Ids(), shared.value
        for b in batches:
            p = _scores(net, b.column(1), ids)
            at = np.array([net.thresholds.get(x or "", net.threshold) for x in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(at), pa.array(p >= at)], ["doc_id", "score", "threshold", "toxic"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return plain.mapInArrow(tidy(run), "doc_id long, score double, threshold double, toxic boolean")


def reject_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below their language's threshold.

    Null and empty texts score alike; null and unknown languages take the threshold of all; repeated rows go or stay
    together. Without labels of both classes nothing is known and nothing goes, unless every label is toxic.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for b in batches:
            p = _scores(net.value, b.column(text), ids)
            at = np.array([net.value.thresholds.get(x or "", net.value.threshold) for x in b.column(lang).to_pylist()], float)
            yield b.filter(pa.array(p < at))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, toxic): predicted is score >= PREDICT_AT, toxic goes by the language.

    held_out: crc32(doc_id as text) mod 4 is 2 (a null doc_id counts as the text ''). Without labels of both classes
    the score is a constant near the class that there is; without any it is one half and no document is toxic.
    """
    found = scored(docs, train(docs, labels, **how))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "threshold", "toxic")
