import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from quern.llm import kneser_ney as K


def toks(t):
    return (t or "").encode().lower().split() + [b"\n"]


def discounts(values):
    n = [sum(v == i for v in values) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return [0, *np.clip(d, [0.05, 0.1, 0.1], [0.95, 1.9, 2.9])]


class Brute:
    def __init__(self, texts):
        self.c, self.bi = Counter(), Counter()
        for t in texts:
            x = toks(t)
            self.c.update(x)
            self.bi.update(zip([b" ", *x], x))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.ctx, self.follow = defaultdict(list), Counter()
        for (u, w), n in self.bi.items():
            self.ctx[u].append(n)
            self.follow[w] += 1
        self.d, self.dl = discounts(self.bi.values()), discounts(self.follow.values())
        self.spare = sum(self.dl[min(f, 3)] for f in self.follow.values()) / len(self.bi)

    def p(self, u, w):
        f = self.follow.get(w, 0)
        low = max(f - self.dl[min(f, 3)], 0) / len(self.bi) + self.spare / (self.v + 1)
        if u not in self.ctx:
            return low
        total = sum(self.ctx[u])
        gamma = sum(self.d[min(n, 3)] for n in self.ctx[u]) / total
        n = self.bi.get((u, w), 0)
        return max(n - self.d[min(n, 3)], 0) / total + gamma * low

    def score(self, t):
        x = toks(t)
        return (len(x), sum(w in self.c for w in x), sum(log10((self.c.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in x), sum(log10(self.p(u, w)) for u, w in zip([b" ", *x], x)))


@pytest.fixture
def texts():
    rng = random.Random(6)
    words = [f"W{i}" for i in range(60)] + ["the"] * 30 + ["Of", "É"] * 8
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, "", "unseenword x"]


def test_scores_equal_brute_force(spark, make_docs, texts, monkeypatch):
    monkeypatch.setattr(K, "PAIR_BYTES", 500)  # many shards, so that frequent words are dealt out
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    want = Brute(train)
    got = {r.doc_id: r for r in K.held_out_scores(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.train_tokens == want.n
        assert np.allclose((r.n_tokens, r.n_known, r.base_score, r.score), want.score(t))
    # the model is a distribution: over the vocabulary and one unknown word it sums to one
    for u in (b" ", b"the", b"w3", b"nowhere"):
        assert abs(sum(want.p(u, w) for w in [*want.c, b"unknown"]) - 1) < 1e-9
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_small_buffers_count_the_same(spark, make_docs, texts):
    c = K._Counter(lambda k: (k % np.uint64(3)).astype(np.int64))
    keys = np.random.default_rng(1).integers(0, 500, 20_000).astype(np.uint64)
    rows = []
    old, K.BUFFER_KEYS = K.BUFFER_KEYS, 600
    try:
        for a in range(0, len(keys), 100):
            rows += c.add(keys[a : a + 100])
        rows += c.flush()
    finally:
        K.BUFFER_KEYS = old
    import pyarrow as pa

    t = pa.Table.from_batches(rows)
    k, n = K._gather(t)
    assert dict(zip(k.tolist(), n.tolist())) == Counter(keys.tolist())
    assert set(t["part"].to_pylist()) == {0, 1, 2}


def test_empty_null_and_repeated_rows(spark, make_docs):
    assert K.held_out_scores(make_docs([])).collect() == []
    got = K.held_out_scores(make_docs([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)])).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 1}
    one = next(r for r in got if r.doc_id is None)
    assert (one.held_out, one.n_tokens, one.n_known) == (True, 1, 1)
    none = K.held_out_scores(make_docs([(None, "a", None)])).collect()[0]
    assert (none.train_tokens, none.n_known, none.score) == (0, 0, 0.0)


def test_answers_are_what_the_shards_hold(spark, make_docs, texts, monkeypatch):
    monkeypatch.setattr(K, "PAIR_BYTES", 500)
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)]).coalesce(1)
    model = K.train(docs.where("doc_id % 3 > 0"))
    rows = docs.select("text")
    hashes = K._Hashes()
    batches = [K.hashed(r.text, hashes) for r in rows.collect()]
    for tokens in (1, 10**9):  # one file, and many
        answers = K.asked(rows, 0, model, tokens)
        words, back = np.unique(np.concatenate([*batches, np.array([K.BEGIN], np.uint64)]), return_inverse=True)
        ids, starts = model.number(words), np.cumsum([0, *map(len, batches[:-1])])
        u = np.r_[back[-1], back[:-2]]
        u[starts] = back[-1]
        _, keys, _ = model.keys(ids[u], ids[back[:-1]])
        order, cuts = model.by_shard(keys)
        want = np.concatenate([model.counts(s, keys[order[a:b]]) for s, (a, b) in enumerate(zip(cuts, cuts[1:]))])
        assert answers.find(keys).tolist() == want.tolist() and want.sum() > 0 and answers.find(keys[1:]) is None
        assert all((a == b).all() for a, b in zip(model.score(batches, answers), model.score(batches)))
    assert K.asked(rows.limit(0), 0, model, 1).find(keys) is None
