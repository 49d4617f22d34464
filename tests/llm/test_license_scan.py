"""The license scan against brute force: every block with every template, every place with every phrase."""

import math
import random
import re
from collections import Counter

from quern.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, places string, blocks string, row string, label string, matches string, n long, i int, rank int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, phrases, templates, threshold, step):
    w = WORD.findall(lower(text))
    found = [(i, label) for label, p in phrases for i in range(len(w)) if w[i : i + len(L.tokens(p))] == L.tokens(p)]
    shares = Counter()
    for b in range(0, len(w), step):
        block = set(w[b : b + 2 * step])
        for label, t in templates:
            t = set(L.tokens(t))
            if len(block & t) >= math.ceil(threshold * len(t) - 1e-9):
                shares[label] = max(shares[label], len(block & t) / len(t))
    at, base = [i for i, _ in found], sorted({x for _, x in found})
    score = 1.0 if found else max(shares.values(), default=0.0)
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *shares})), round(score, 9)


def answers(df):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in df.collect())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *["clash"] * 5, 1, 2, 3) for i, t in texts], DOCS)


def check(spark, texts, phrases=L.PHRASES, templates=L.TEMPLATES, threshold=L.THRESHOLD, step=L.STEP):
    got = answers(L.scan(frame(spark, texts), phrases, templates, threshold, step))
    want = Counter((i, *brute(t, phrases, templates, threshold, step)) for i, t in texts)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_notices_in_prose_whole_damaged_and_cut(spark):
    rng = random.Random(5)
    words = "the of and to in a is mit with software under work terms free license public version copy this der die und".split()
    texts = []
    for i in range(300):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(L.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                notice = [x for x in notice if rng.random() < 0.93]
            at = rng.randrange(len(t) + 1)
            t[at:at] = notice
        texts.append((i, rng.choice([" ", "\n", ", ", " -- "]).join(t)))
    check(spark, texts)
    check(spark, texts, threshold=0.7)
    check(spark, texts, threshold=0.5, step=7)


def test_random_sets_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    draw = lambda n: " ".join(rng.choices(words, weights, k=n))
    templates = [(f"t{i % 9}", draw(rng.randrange(1, 12))) for i in range(40)]
    check(spark, [(i, draw(rng.randrange(0, 60))) for i in range(200)], [("p", "w0 w1"), ("q", "w0"), ("q", "w2 w2")], templates, 0.8, 5)


def test_awkward_texts(spark):
    long = " ".join(f"word{i % 999}" for i in range(120_000)) + " Released under the MIT License. " + "x" * 200_000
    texts = [
        (1, None), (2, ""), (3, " .\n\t;"), (4, long), (5, "MIT License mit license MIT\tLICENSE"), (5, "MIT License mit license MIT\tLICENSE"), (None, "CC BY-NC 4.0"), (None, None), (6, "licensed under the ÀPACHE license ÉÜ日本"),
        (7, "the worK is licensed under the GNU General Public License version 3"), (8, "smıt license İ mit license mit license's"), (9, "gnu\x00general\x7fpublic`license"), (10, "cc by cc by"),
    ]
    check(spark, texts)
    check(spark, texts, phrases=[])
    assert all(r.labels == r.base_labels and r.matches == [] for r in L.scan(frame(spark, texts), templates=[]).collect())
    assert L.scan(frame(spark, texts).limit(0)).collect() == []


def test_templates_fit_a_block_and_are_found_in_themselves(spark):
    assert all(len(L.tokens(t)) <= L.STEP + 1 for _, t in L.TEMPLATES)
    rows = L.scan(frame(spark, list(enumerate(t for _, t in L.TEMPLATES)))).collect()
    assert all(L.TEMPLATES[r.doc_id][0] in r.labels.split(",") for r in rows)


def test_the_main_path_has_no_python(spark):
    plan = L.scan(frame(spark, [(1, "Released under the MIT License")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
