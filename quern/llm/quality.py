"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown in numpy on histograms, with monotonic constraints on chosen features, and flattened into node
arrays (feature, threshold, left, right, value), over which all rows of a batch descend together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, tidy

#: Characters counted as symbols, and the words of the window in which repeats are looked for.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
WHITE = " \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees see, and their constraint: -1, the score never rises with the value; 1, it never falls; 0, free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "short_share": 0,
    "digit_rate": 0, "upper_rate": 0, "punct_rate": 0, "non_ascii_rate": 0, "log_line_words": 0, "longest_word": 0,
}
#: Labelled rows that are fitted on, at most: those with the smallest hash of their doc_id.
MAX_FIT_ROWS = 20_000


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of WINDOW words."""
    h = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = (h ^ ids[i : len(ids) - WINDOW + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five that the text holds twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = _mixed(ids)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    marks = np.zeros(len(words) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The counts and the features of one whole text; null as empty."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(t) - sum(map(t.count, WHITE))
    symbols = sum(map(t.count, SYMBOLS))
    seen, dup, full = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            full += 1
            dup += line in seen
            seen.add(line)
    repeat = repeat_words(words)
    m, c = max(n, 1), max(chars, 1)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lens = np.fromiter(map(len, words), np.int64, n)
    features = [
        np.log1p(n), chars / m, symbols / c, dup / max(full, 1), repeat / m, len(set(words)) / m, float((lens <= 3).sum()) / m,
        by[48:58].sum() / c, by[65:91].sum() / c, (by[33:48].sum() + by[58:65].sum()) / c, by[128:].sum() / c, np.log1p(n / max(full, 1)), float(lens.max()) if n else 0.0,
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, the counts, x): x are the features, in the order of FEATURES."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                found = [measure(x.as_py()) for x in b.column(1)]
                counts = np.array([x for x, _ in found], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(COUNTS))), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["doc_id", *COUNTS, "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), schema)


@dataclass
class Forest:
    """Flattened trees: row t of each array is tree t; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int
    cut: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                down = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(down, self.left[t, node], self.right[t, node])
            out += self.value[t, node]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, keep_share: float = 0.998) -> Forest:
    """Boosted trees for log loss. A split on a constrained feature must order its children's values, and hands their
    middle down as a bound, so that the whole score is monotone. ``cut`` accepts ``keep_share`` of the good rows, and
    is at most one half. One class or no row: that class's constant (no row: good)."""
    n, k = x.shape
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    forest = Forest(np.zeros(shape, np.int32), np.full(shape, np.inf), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.zeros(shape), 0.0, depth)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.999
    forest.base = float(np.log(p / (1 - p)))
    if not n or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(edges[j], x[:, j]) for j in range(k)], 1)  # code <= e means x <= edges[e]
    raw = np.full(n, forest.base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        open_ = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while open_:
            node, rows, lo, hi, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            forest.value[t, node] = rate * np.clip(-gs / (hs + l2), lo, hi)
            best = (1e-3, None)
            if level < depth and len(rows) >= 20:
                for j in range(k):
                    if not len(edges[j]):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(edges[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(edges[j]) + 1))[:-1]
                    nl = np.cumsum(np.bincount(code[rows, j], minlength=len(edges[j]) + 1))[:-1]
                    vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
                    gain = -(gl * vl + (hl + l2) * vl**2 / 2) - ((gs - gl) * vr + (hs - hl + l2) * vr**2 / 2)
                    v = np.clip(-gs / (hs + l2), lo, hi)
                    gain += gs * v + (hs + l2) * v**2 / 2
                    ok = (nl >= 10) & (len(rows) - nl >= 10) & ((monotone[j] == 0) | (monotone[j] * (vr - vl) >= 0))
                    if ok.any() and (at := int(np.argmax(np.where(ok, gain, -np.inf)))) is not None and gain[at] > best[0]:
                        best = (gain[at], (j, at, vl[at], vr[at]))
            if best[1] is None:
                raw[rows] += forest.value[t, node]
                continue
            j, at, vl, vr = best[1]
            forest.feature[t, node], forest.threshold[t, node] = j, edges[j][at]
            forest.left[t, node], forest.right[t, node] = 2 * node + 1, 2 * node + 2
            mid = (vl + vr) / 2
            bl, br = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
            down = code[rows, j] <= at
            open_ += [(2 * node + 1, rows[down], *bl, level + 1), (2 * node + 2, rows[~down], *br, level + 1)]
    good = forest.score(x[y == 1])
    forest.cut = float(min(0.5, np.quantile(good, 1 - keep_share)))
    return forest


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS, **how) -> Forest:
    """Fits on at most ``max_rows`` labelled documents, chosen by the hash of doc_id. Rows with a null label are left out."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    rows = stats.select("doc_id", "x").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).collect()
    x = np.array([r.x for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in rows], float), list(FEATURES.values()), **how)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """Adds quality_score, which stands in the place of x."""
    plain = [c for c in stats.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.get_field_index("x"))
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in plain), pa.array(forest.score(m))], [*plain, "quality_score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in stats.dtypes if c != "x") + ", quality_score double"
    return stats.mapInArrow(tidy(run), schema)


def rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, the counts, quality_score, base_failed, kept) of every document.

    base_failed: under 10 words, or over a fifth of the words repeat in windows of five. kept: not base_failed, and
    the score is at least the forest's cut. Null and empty texts have no words and fail. No labels: every document
    that passes the base rules is kept.
    """
    stats = cut(statistics(docs))
    forest = train(stats, labels, max_rows=max_rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored(stats, forest).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= F.lit(forest.cut)))
