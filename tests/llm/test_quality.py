import random
import re

import numpy as np

from quern.llm import quality


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(win):
        if win.count(w) > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)]


def test_counts_equal_brute_force():
    rng = random.Random(4)
    for n in (0, 1, 4, 5, 6, 40, 120):
        t = "".join(rng.choice(["a", "bé", "#c", "d|", "\x85"]) + rng.choice([" ", "\n", "\t", "\x0b "]) for _ in range(n))
        assert quality.measure(t)[0] == brute(t)
    assert quality.measure("x y z a b\nx y z a b\n\n \n")[0] == brute("x y z a b\nx y z a b\n\n \n")
    assert quality.measure(None)[0] == [0] * 5


def test_forest_is_monotone_and_accurate():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] < 0.6) & (np.abs(x[:, 1] - 0.5) < 0.3)).astype(float)
    f = quality.fit(x[:3000], y[:3000], [-1, 0, 0])
    assert ((f.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    grid = np.repeat(rng.random((50, 3)), 60, axis=0)
    grid[:, 0] = np.tile(np.linspace(-1, 2, 60), 50)
    assert (np.diff(f.score(grid).reshape(50, 60), axis=1) <= 1e-12).all()


def test_rules_on_held_out_rows_and_odd_inputs(spark, make_docs):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "of", f"w{rng.randrange(9999)}", f"word{rng.randrange(9999)}"]) for _ in range(60))
    bad = lambda: " | ".join(f"longword{rng.randrange(9999)}" for _ in range(40))
    texts = [good() if i % 2 else bad() for i in range(600)]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)] + [(None, None, None), (700, "", "s"), (700, "", "s")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(301, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rules(docs, labels).collect()}
    assert np.mean([got[i].kept == bool(i % 2) for i in range(300, 600)]) > 0.97
    assert got[None].base_failed and not got[700].kept
    assert all(r.kept or r.base_failed for r in quality.rules(docs, labels.limit(0)).collect())
    assert quality.rules(make_docs([]), labels).collect() == []


def test_flat_trees_score_as_a_walk_does():
    rng = np.random.default_rng(7)
    x = rng.random((900, 4))
    f = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), [0, 1, 0, -1], trees=12)
    for row, got in zip(x[:200], f.score(x[:200])):
        z = f.base
        for t in range(len(f.feature)):
            node = 0
            while f.left[t, node] != node:
                node = f.left[t, node] if row[f.feature[t, node]] <= f.threshold[t, node] else f.right[t, node]
            z += f.value[t, node]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12
