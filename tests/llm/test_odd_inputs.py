"""Every operator on one awkward table: nulls in any column, empty and very long texts, ties, repeated rows, and columns
that are named like the operators' own."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, kneser_ney, line_runs, link_graph, lm_quality, mixing, near_text, quality, sharding, simhash, toxicity

CLASHES = ["fp", "component_id", "k1", "k2", "h", "rank", "slot", "position", "shard", "score", "kept", "key", "label", "head", "n", "x", "pos", "first", "t1", "gone", "matches", "host", "rep", "size", "row_key", "_row_key", "_position", "Row", "ref", "n_words", "__a", "__b", "__p", "__d", "__s", "__k", "__k1", "__r", "__n", "__o0", "__key", "__text"]
LONG = " ".join(f"word{i % 5000}" for i in range(250_000))
ROWS = [
    (1, "a plain text of several words, nothing more to it than that", "en", "s0"), (2, "A plain text of several words, nothing more to it than that", "en", "s0"), (2, "A plain text of several words, nothing more to it than that", "en", "s0"),
    (3, None, "en", "s1"), (4, "", None, None), (5, " \t\n\x0b\x0c\r ", "de", "s1"), (None, "no id here but some words all the same, and ten of them", None, "s0"), (None, None, None, None), (None, None, None, None),
    (6, LONG, "en", "s0"), (7, "one", "fr", "s0"), (8, "\n\n\n", "fr", ""), (9, "ß É 日本語 \U0001f600 ｗｉｄｅ \x85   words", "xx", "s0"), (-5, "negative id", "en", "s0"), (2**62, "large id", "en", "s0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int").withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "several words, nothing more to it"), (None, None), (2, ""), (2, "absent from all of them, this passage")], "item_id long, text string").withColumn("matches", F.lit("clash"))


IDS = Counter(r[0] for r in ROWS)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_every_row_is_answered_once(docs, labels, benchmark):
    for df in (
        quality.rules(docs, labels), decontaminate.matches(docs, benchmark), mixing.mix(docs), simhash.near_duplicates(docs), sharding.shard(docs), line_runs.drop_frequent(docs, min_docs=2),
        kneser_ney.held_out_scores(docs), lm_quality.classify(docs, labels), toxicity.classify(docs, labels), near_text.classes(docs),
    ):
        assert ids(df) == IDS


def test_filters_keep_columns_and_rows(docs, labels, benchmark):
    for df in (toxicity.reject_toxic(docs, labels), decontaminate.drop_contaminated(docs, benchmark), near_text.keep_one(docs), mixing.reorder(docs)):
        assert df.dtypes == docs.dtypes
        assert all(r.fp == "clash" for r in df.select("fp").collect())
    assert ids(mixing.reorder(docs)) == IDS
    assert ids(decontaminate.drop_contaminated(docs, benchmark)) == IDS - Counter([1, 2, 2])
    left = ids(near_text.keep_one(docs))
    assert left[1] == 1 and left[2] == 0 and left[None] + left[3] + left[4] == 2 and left[6] == 1


def test_ties_and_long_texts(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got[1].fp == got[2].fp and got[1].component_id == got[2].component_id == 1
    assert got[3].fp == got[4].fp == got[5].fp == got[8].fp == 0 and got[3].component_id == 3
    n = {r.doc_id: r for r in quality.statistics(docs).collect()}
    assert n[6].n_words == 250_000 and n[6].n_repeat_words == 250_000 and n[9].n_words == len(re.findall(r"[^\x20\x09-\x0D]+", ROWS[12][1]))
    assert {r.doc_id: r.n_tokens for r in kneser_ney.held_out_scores(docs).collect()}[6] == 250_001


def test_pages(spark):
    rows = [(1, "http://a.com/en/1", "<a href='http://b.org'>" * 50_000), (1, "http://a.com/en/1", None), (None, None, None), (2, "", ""), (3, "://", "x"), (4, "http://[::1]:80/p", "<a href=>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, trust string")
    got = link_graph.filter_urls(pages, [link_graph.Rule.of("block", "com/")])
    assert Counter(r.page_id for r in got.collect()) == Counter(r[0] for r in rows)


def test_empty_tables(spark, docs, labels, benchmark):
    none = docs.limit(0)
    for df in (quality.rules(none, labels), decontaminate.matches(none, benchmark), mixing.mix(none), simhash.near_duplicates(none), sharding.shard(none), line_runs.drop_frequent(none), kneser_ney.held_out_scores(none), lm_quality.classify(none, labels.limit(0)), toxicity.classify(none, labels.limit(0)), near_text.keep_one(none), mixing.reorder(none)):
        assert df.count() == 0


def test_pipeline_stages_on_awkward_tables(spark, docs, labels, benchmark, tmp_path):
    import corpus_pipeline

    for name, t in (("labels", labels.where("toxic = 7")), ("benchmark", benchmark)):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    for start in (docs, docs.limit(0)):
        rows, sizes = start, [start.count()]
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, str(tmp_path))
            if i < 4:
                assert rows.dtypes == docs.dtypes
            path = f"{tmp_path}/{start is docs}-{i}"
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
            sizes.append(rows.count())
        assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[-1]
        left = rows.collect()
        assert len({(r.shard, r.slot) for r in left}) == len(left) == len({r.mix_position for r in left})
        assert not left or {1, 2} & {r.doc_id for r in left} == set() and len([r for r in left if r.doc_id in (3, 4, None)]) >= 2
