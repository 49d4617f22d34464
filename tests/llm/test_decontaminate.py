import random

import numpy as np

from quern.llm import decontaminate as D


def best_edits(item, text):
    """Semi-global edit distance, plainly."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def changed(rng, s, k):
    s = list(s)
    for _ in range(k):
        p = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[p] = rng.choice("xyzß")
        elif what == 1:
            s.insert(p, rng.choice("xyz"))
        else:
            del s[p]
    return "".join(s)


def made(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_find_equals_brute_force(monkeypatch):
    rng = random.Random(3)
    items = [(i, made(rng, rng.choice([2, 12, 25]))) for i in range(12)] + [(98, "tiny"), (99, None), (100, " ")]
    index = D.Index.of(items)
    held = [D._plain(index.text(i)) for i in range(len(index.ids))]
    texts = []
    for n in range(120):
        i = rng.randrange(13)
        mid = changed(rng, items[i][1], rng.randrange(0, 9))
        texts.append(D.normal(made(rng, rng.randrange(0, 30)) + " " + mid + " " + made(rng, rng.randrange(0, 30))))
    got = D.find(index, texts)
    for t, found in zip(texts, got):
        want = {index.id(i): e for i, x in enumerate(held) if (e := best_edits(x, t)) <= index.budget[i]}
        assert {m[0]: m[3] for m in found} == want
        for m in found:
            assert best_edits(held[index.ids.tolist().index(m[0])], t[m[1] : m[2]]) == m[3]
    # q-grams that stand in many items are looked at some at a time, to the same end
    monkeypatch.setattr(D, "POSTINGS", 50)
    assert D.find(index, texts) == got


def test_grams_tell_windows_apart():
    codes = np.arange(300, dtype=np.uint32) % 97
    h = D.grams(codes, 12)
    assert len(h) == 289 and h[0] == h[97] and len(set(h.tolist())) == 97


def test_matches_blocks_and_odd_inputs(spark):
    rng = random.Random(8)
    bench = [(i, made(rng, 20)) for i in range(30)] + [(30, None), (None, made(rng, 20))]
    rows = [(i, made(rng, 40) + "\n" + bench[i % 32][1].upper() if i % 3 == 0 and bench[i % 32][1] else made(rng, 40), "e") for i in range(90)]
    rows += [(900, None, "e"), (901, "", "e"), (None, bench[0][1], "e"), (None, bench[0][1], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    one = sorted(((r.doc_id, sorted(str(m.item_id) for m in r.matches)) for r in D.matches(docs, b).collect()), key=str)
    many = sorted(((r.doc_id, sorted(str(m.item_id) for m in r.matches)) for r in D.matches(docs, b, block_chars=500).collect()), key=str)
    assert one == many
    assert one == sorted(((i, [str(bench[i % 32][0])] if i is not None and i % 3 == 0 and i < 900 and bench[i % 32][1] else ["0"] if i is None else []) for i, _, _ in rows), key=str)
    left = D.drop_contaminated(docs, b, block_chars=500)
    assert left.dtypes == docs.dtypes and sorted(r.doc_id for r in left.collect()) == sorted(i for i, m in one if not m)
    assert D.matches(docs.limit(0), b).count() == 0 and D.drop_contaminated(docs, b.limit(0)).count() == len(rows)


def test_short_items_have_their_edits_too(spark):
    rng = random.Random(4)
    bench = [(n, made(rng, 12)[:n].strip().ljust(n, "x")) for n in (5, 9, 10, 12, 15, 19, 20, 23, 30, 31, 40)]
    rows = []
    for i, (n, t) in enumerate(bench):
        rows += [(100 * i + k, made(rng, 9) + changed(rng, t, k) + made(rng, 9)) for k in range(0, 6)]
    got = {r.doc_id: {m.item_id: m.edits for m in r.matches} for r in D.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for i, t in rows:
        t = D.normal(t)
        assert got[i] == {n: e for n, x in bench if (e := best_edits(D.normal(x), t)) <= int(len(D.normal(x)) * D.EDIT_RATE)}


def test_a_benchmark_of_many_blocks(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    bench = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(5000)]  # 2 million characters
    rows = [(i, f"before {bench[i][1]} after") for i in range(0, 5000, 50)] + [(-1, " ".join(words))]
    docs, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: [m.item_id for m in r.matches] for r in D.matches(docs, b, block_chars=100_000).collect()}
    assert got == {i: [i] if i >= 0 else [] for i, _ in rows}
