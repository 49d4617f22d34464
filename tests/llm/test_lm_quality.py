import random
import zlib

import numpy as np

from quern.llm import lm_quality as Q
from tests.llm.test_kneser_ney import Brute


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(3)
    words = {"en": [f"e{i}" for i in range(300)], "de": [f"d{i}" for i in range(300)]}
    good = lambda x: " ".join(rng.choice(words[x]) for _ in range(rng.choice([3, 40, 200])))
    junk = lambda: " ".join(f"{rng.randrange(10**9)}%%" for _ in range(60))
    rows = [(i, good("en" if i % 2 else "de") if i % 5 else junk(), "en" if i % 2 else "de") for i in range(2000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows] + [(None, None, None, None), (5000, "", "en", None), (5000, "", "en", None), (5001, junk(), "xx", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(1000)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert np.mean([got[i].kept for i in range(1000, 2000) if i % 5]) > 0.985
    assert not any(got[i].kept for i in range(1000, 2000) if not i % 5) and not got[5001].kept
    assert got[None].kept and got[5000].kept and got[None].n_tokens == 1
    assert abs(got[7].perplexity - 10 ** (-got[7].score / got[7].n_tokens)) < 1e-6
    assert Q.classify(docs, labels).count() == 2004
    assert all(r.kept for r in Q.classify(docs, labels.limit(0)).collect())
    assert Q.classify(docs.limit(0), labels).collect() == []


def test_thresholds_are_the_languages_quantiles():
    rng = np.random.default_rng(0)
    score, tokens = -rng.random(400) * 300 - 10, np.full(400, 100.0)
    lang = ["a"] * 200 + ["b"] * 190 + ["c"] * 10
    t = Q.thresholds(lang, score, tokens, 0.9)
    assert set(t.least) == {"a", "b"}
    for x, part in (("a", slice(0, 200)), ("b", slice(200, 390))):
        assert np.mean(Q.adjusted(score[part], tokens[part], t.mean[x]) >= t.least[x]) == 0.9


def test_a_rare_language_has_its_own_quantile_in_a_large_corpus(spark):
    rng = np.random.default_rng(1)
    lang = ["big"] * 20_000 + ["rare"] * 100 + ["few"] * 10 + [None] * 5
    score, tokens = -rng.random(len(lang)) * 300 - 10, rng.integers(20, 200, len(lang))
    held = spark.createDataFrame(list(zip(lang, score.tolist(), tokens.tolist())), "lang string, score double, n_tokens long")
    got, want = Q.thresholds_of(held, 0.9), Q.thresholds(lang, score, tokens, 0.9)
    assert set(got.least) == {"big", "rare"} and np.allclose([got.any_mean, got.any_least], [want.any_mean, want.any_least])
    assert all(np.isclose(got.least[x], want.least[x]) and np.isclose(got.mean[x], want.mean[x]) for x in got.least)
    labels = spark.range(40_000).selectExpr("id as doc_id", "1 as quality")
    assert Q.trusted(labels).count() == 40_000


def test_classification_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(words if rng.random() < 0.97 else ["odd", f"n{rng.randrange(99)}"]) for _ in range(rng.randrange(0, 40))), rng.choice(["a", "a", "b", None])) for i in range(600)]
    rows += [rows[3]] * 2 + [(None, "w1 w2", "a"), (601, None, "b")]
    good = {i: int(rng.random() < 0.8) for i in range(0, 600) if i % 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in good.items()] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    good[5] = 0
    fits = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    model = Brute([t for i, t, _ in rows if good.get(i) and fits(i)])
    held = [(x or "", *model.score(t)) for i, t, x in rows if good.get(i) and not fits(i)]
    t = Q.thresholds([h[0] for h in held], np.array([h[4] for h in held]), np.array([float(h[1]) for h in held]), 0.9)
    want = []
    for i, text, x in rows:
        n, known, _, score = model.score(text)
        least = t.least.get(x, t.any_least)
        want.append((i, n, known, round(score, 4), bool(Q.adjusted(score, n, t.mean.get(x, t.any_mean)) >= least - 1e-9)))
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.score, 4), r.kept) for r in Q.classify(docs, labels, 0.9).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key) and 0 < sum(not r[4] for r in got) < len(got)
