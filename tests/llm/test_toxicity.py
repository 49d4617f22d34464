import random
import zlib

import numpy as np

from quern.llm import toxicity


def made(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 40, 200]))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilexa", "vilexo", "Grumb,", "snarkle"])
        out.append((i, " ".join(words), int(bad)))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_whole_texts(spark):
    rows = made(1600)
    long = " ".join(["plain"] * 70_000 + ["vilexa", "grumb", "snarkle"])
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(9001, long, "fr"), (9002, None, None), (9003, "", "en"), (None, "grumb snarkle vilexo", None)], "doc_id long, text string, lang string")
    # a held-out row's label must not matter
    labels = spark.createDataFrame([(i, 1, y if not held(i) else 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    test = [(got[i].predicted, y) for i, _, y in rows if held(i)]
    assert np.mean([p == y for p, y in test]) > 0.95
    assert all(got[i].held_out == held(i) for i, _, _ in rows)
    assert got[9001].predicted == 1 and got[9002].predicted == got[9003].predicted == 0 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_reject_keeps_columns_and_odd_inputs(spark):
    rows = made(800, 3)
    schema = "doc_id long, text string, lang string, score string, toxic long"
    docs = spark.createDataFrame([(i, t, "en", "x", 5) for i, t, _ in rows] + [(None, None, None, None, None)] * 2, schema)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.dtypes == docs.dtypes
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2
    assert np.mean([(i in set(ids)) == (y == 0) for i, _, y in rows]) > 0.95
    assert toxicity.reject_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.reject_toxic(docs, labels.limit(0)).count() == 802
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_convolution_and_pooling_equal_brute_force():
    rng = np.random.default_rng(2)
    net = toxicity.Net.new(3)
    net.out = rng.normal(size=net.out.shape).astype(np.float32)
    net.bias = [rng.normal(size=b.shape).astype(np.float32) * 0.1 for b in net.bias]
    ids = toxicity._Ids()
    texts = ["", "one", "two words", " ".join(f"w{i % 7}" for i in range(40)), None, " ".join(f"v{i % 300}" for i in range(70_000))]
    docs = [toxicity.tokens(t, ids) for t in texts]
    got = net.logit(docs)
    for n, d in enumerate(docs):
        d = d[: len(d) if len(d) < 1000 else 3000]
        x = np.array([sum(net.emb[u] for u in row) for row in d], float)
        best = []
        for w, b in zip(net.filters, net.bias):
            places = [sum(x[at + j] @ w[j].astype(float) for j in range(len(w))) + b for at in range(len(x) - len(w) + 1)]
            best += np.maximum(np.max(places, axis=0), 0).tolist()
        # a text's places may reach over its padding, into nothing
        want = float(np.dot(best, net.out) + net.out_bias)
        if n < 5:
            assert abs(got[n] - want) < 1e-3
        else:  # the long text repeats itself every 300 words, so its first 3000 hold every place but those at its end
            assert abs(got[n] - want) < 0.2
    # together or one by one
    assert np.allclose(got, [float(net.logit([d])[0]) for d in docs], atol=1e-4)


def test_fitting_lowers_the_loss_and_thresholds_are_the_best():
    rows = made(300, 5)
    ids = toxicity._Ids()
    docs, y = [toxicity.tokens(t, ids) for _, t, _ in rows], np.array([float(b) for *_, b in rows])
    loss = lambda net: float(np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * net.logit(docs)))))
    first, last = toxicity.fit(docs, y, epochs=0), toxicity.fit(docs, y, epochs=6)
    assert loss(last) < 0.5 * loss(first) and loss(last) < 0.1
    rng = np.random.default_rng(4)
    for _ in range(30):
        p, label = np.round(rng.random(40), 2), rng.integers(0, 2, 40).astype(float)
        label[0] = 1
        f1 = lambda t: 2 * label[p >= t].sum() / ((p >= t).sum() + label.sum())
        t = toxicity._best(p, label)
        assert 0.05 <= t <= 0.95 and (f1(t) >= max(map(f1, p)) - 1e-12 or t in (0.05, 0.95))


def test_repeated_labelled_rows_do_not_outgrow_the_bounds(spark):
    rows = made(400, 6)
    same = spark.range(20_000).selectExpr("cast(1 as long) as doc_id", "concat('filler ', id % 9000) as text", "'en' as lang")
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string").unionAll(same)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    net = toxicity.train(docs, labels, max_rows=300, max_calibration=100)
    assert net.thresholds or net.threshold
    assert toxicity.train(docs, labels, max_bytes=10_000).threshold > 0  # whole texts only, as many as fit


def test_all_labelled_rows_are_learned_from_in_shards(spark):
    rows = made(1600, 8)
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, max_rows=200, max_calibration=80).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if held(i)]) > 0.95
    # every row that isn't held out has its say, however few a shard takes
    seen = []
    start = toxicity._start
    toxicity._start = lambda counts, seed: seen.append(counts[:, -1].tolist()) or start(counts, seed)
    try:
        net = toxicity.train(docs.unionAll(docs), labels, max_rows=100, epochs=1)
    finally:
        toxicity._start = start
    fitted = [y for i, _, y in rows if not held(i) and zlib.crc32(str(i).encode()) >> 2 & 3]
    assert seen == [[fitted.count(0), fitted.count(1)]] and set(net.thresholds) == {"en", "fr"}


def test_thresholds_by_ranges_are_the_best(spark):
    rng = np.random.default_rng(9)
    rows = [(lang, float(p), int(y)) for lang, n in (("a", 300), ("b", 90), ("", 60), ("few", 15)) for p, y in zip(np.round(rng.random(n), 2), rng.integers(0, 2, n))]
    got = toxicity.thresholds(spark.createDataFrame(rows, "lang string, p double, y int"), limit=20)
    assert set(got) == {None, "a", "b", ""}
    for lang, t in got.items():
        own = [(p, y) for x, p, y in rows if lang in (None, x)]
        assert abs(t - toxicity._best(np.array([p for p, _ in own]), np.array([float(y) for _, y in own]))) < 1e-12


def test_long_texts_peak_in_blocks_as_they_do_whole(monkeypatch):
    net, ids = toxicity.Net.new(3), toxicity._Ids()
    doc = toxicity.tokens(" ".join(f"w{i * i % 997}" for i in range(900)), ids)
    whole = toxicity._peaks(net, [doc])
    monkeypatch.setattr(toxicity, "STEP_WORDS", 64)
    cut = toxicity._peaks(net, [doc])
    assert np.allclose(whole[0], cut[0], atol=1e-5)
