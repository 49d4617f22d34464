"""Quality classifier: a Kneser-Ney model of trusted text, and per-document perplexity held against its language.

The model's counts are sharded (see kneser_ney); documents' n-grams are sent to the shards that hold them, merge-joined
there, and the counts sent back by batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kneser_ney
from quern.llm.common import cut, tidy
from quern.llm.near_text import KeyFile
from quern.operators import stats

#: A document's mean is taken together with so many tokens of its language's mean, so that short texts aren't judged by
#: a few rare words.
PRIOR_TOKENS = 30
QUANTILE = 0.998


@dataclass
class Thresholds:
    """By language: the mean log10 probability of a token, and the least adjusted mean that is kept."""

    mean: dict[str, float]
    least: dict[str, float]
    any_mean: float
    any_least: float


def adjusted(score, tokens, mean):
    return (score + PRIOR_TOKENS * mean) / (tokens + PRIOR_TOKENS)


def thresholds(lang: list[str | None], score: np.ndarray, tokens: np.ndarray, quantile: float = QUANTILE, rows: int = 50) -> Thresholds:
    """The quantile of each language with ``rows`` calibration documents; others, and null, take that of all.
    No calibration document: everything is kept."""
    if not len(score):
        return Thresholds({}, {}, 0.0, -np.inf)
    names = np.array([x or "" for x in lang])
    any_mean = float(score.sum() / tokens.sum())
    out = Thresholds({}, {}, any_mean, float(np.quantile(adjusted(score, tokens, any_mean), 1 - quantile)))
    for x in np.unique(names).tolist():
        at = names == x
        if at.sum() >= rows and x:
            m = float(score[at].sum() / tokens[at].sum())
            out.mean[x], out.least[x] = m, float(np.quantile(adjusted(score[at], tokens[at], m), 1 - quantile))
    return out


def thresholds_of(held: DataFrame, quantile: float = QUANTILE, rows: int = 50) -> Thresholds:
    """``thresholds`` of all rows (lang, score, n_tokens) of held, worked out in Spark. Means are rounded, so that the order
    of a sum can't move them."""
    mean = F.round(F.sum("score") / F.sum("n_tokens"), 9)
    any_mean = held.agg(mean).first()[0]
    if any_mean is None:
        return thresholds([], np.zeros(0), np.zeros(0), quantile)
    named = held.where("lang <> ''")
    by = {r.lang: r.m for r in named.groupBy("lang").agg(mean.alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= rows).collect()}
    if not by:
        return Thresholds({}, {}, any_mean, _least(held, [], F.lit(any_mean), quantile)[0].q)
    of = F.coalesce(*(F.when(F.col("lang") == x, F.lit(m)) for x, m in sorted(by.items())))
    found = {r.lang: r.q for r in _least(named.where(F.col("lang").isin(sorted(by))), ["lang"], of, quantile)}
    return Thresholds(by, found, any_mean, _least(held, [], F.lit(any_mean), quantile)[0].q)


def _least(held: DataFrame, group: list[str], mean, quantile: float) -> list:
    """The exact quantile of each group's adjusted means, whatever its size (see ``stats.quantiles``): a row a group."""
    x = held.select(*group, adjusted(F.col("score"), F.col("n_tokens"), mean).alias("x"))
    return stats.quantiles(x, group, {"q": ("x", 1 - quantile)}).collect()


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, fit): labelled rows of quality 1; a fifth of them, by crc32 of doc_id, only calibrates (fit is false)."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("q")).where("q = 1")
    return cut(good.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 != 0).alias("fit")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_tokens, n_known, score, perplexity, threshold, kept) of every document.

    perplexity is 10 ** (-score / n_tokens), threshold the largest adjusted perplexity that the document's language
    keeps (see PRIOR_TOKENS). Null and empty texts are their end alone; repeated rows are answered one by one. Without
    trusted documents everything is kept.
    """
    fits = KeyFile(trusted(labels).select("doc_id", F.col("fit").cast("long").alias("fit")), "trusted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def known(fit: int) -> DataFrame:
        """The trusted documents that are learned from (1) or calibrated on (0), looked up where they are: no text moves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(fits.values(b.column(0).to_numpy(zero_copy_only=False)) == fit))

        return rows.where("doc_id is not null").mapInArrow(tidy(run), rows.schema)

    model = kneser_ney.train(known(1), "quality-model")
    t = thresholds_of(cut(kneser_ney.score(known(0), model, ["doc_id", "lang"], join=True)), quantile)
    found = kneser_ney.score(rows, model, ["doc_id", "lang"], join=True)
    of = lambda by, other: F.coalesce(*(F.when(F.col("lang") == x, F.lit(v)) for x, v in sorted(by.items())), F.lit(other))
    found = found.withColumn("mean", of(t.mean, t.any_mean)).withColumn("least", of(t.least, t.any_least))
    kept = adjusted(F.col("score"), F.col("n_tokens"), F.col("mean")) >= F.col("least")
    return found.select("doc_id", "lang", "n_tokens", "n_known", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.col("least")).alias("threshold"), kept.alias("kept"))
