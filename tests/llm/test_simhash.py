import random

import numpy as np
import xxhash

from quern.llm import simhash
from quern.llm.common import components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, budget):
    comp = dict(zip(range(len(ids)), range(len(ids))))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
                comp[b] = a
    return [ids[find(i)] for i in range(len(ids))]


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        t = " ".join(rng.choice(["Ab", "c", "dÉ", "e\x85f", "g"]) for _ in range(n))
        assert simhash.fingerprint(t) == brute_fp(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0


def test_trie_links_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    keys = set(base.tolist())
    for b in base.tolist():
        for _ in range(8):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            keys.add(x)
    keys = np.array(sorted(keys), np.uint64)
    for budget in (1, 3, 5):
        lab = simhash.trie_links(keys, budget)
        want = brute_components(list(range(len(keys))), keys.tolist(), budget)
        assert lab.tolist() == want


def test_near_duplicates_equal_brute_force(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 30, 300]))]
        for _ in range(4):
            t = list(base)
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", "  ", "one", "ONE", "one two"]
    rows = [(i * 7 % 1009, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    ids, fps = [r[0] for r in rows], [brute_fp(r[1]) for r in rows]
    assert got == {i: (f, c) for i, f, c in zip(ids, fps, brute_components(ids, fps, 3))}


def test_empty_repeated_and_null_rows(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", "s"), (None, "x y z q", None)]
    got = sorted(map(tuple, simhash.near_duplicates(make_docs(rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None)], key=str)


def test_trie_pairs_are_all_pairs_of_different_labels():
    rng = np.random.default_rng(4)
    heads = np.sort(rng.integers(0, 5, 700))
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    keys = base[rng.integers(0, 6, 700)] ^ (np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64))
    keys[::9] = base[0]
    order = np.lexsort((keys, heads))
    heads, keys, label = heads[order], keys[order], rng.integers(0, 40, 700)
    near = (heads[:, None] == heads) & (label[:, None] != label)
    for budget in (2, 4, 19):
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near & (np.bitwise_count(keys[:, None] ^ keys) <= budget), 1)))}
        for leaf in (1, 64):
            got = [(i, j) for x in simhash.trie_pairs(keys, heads, budget, simhash.Labels(label), leaf=leaf, step=100) for i, j in zip(*x)]
            assert len(got) == len(set(got)) and set(got) == want


def test_null_ids_bridge_and_never_name_a_class(spark, monkeypatch):
    # 0b000, 0b111, 0b111111: the middle one alone links the other two at three bits
    cases = [[(9, 0), (None, 0b111), (4, 0b111111)], [(None, 0), (2, 0b111), (1, 0b111111)], [(None, 0), (None, 1), (None, 3)], [(5, 0), (5, 0), (None, 0), (3, 2**40 - 1)]]
    for rows in cases:
        fps = spark.createDataFrame(rows, "doc_id long, fp long")
        monkeypatch.setattr(simhash, "fingerprints", lambda *a, fps=fps, **k: fps)
        got = sorted((r.fp, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(fps).collect())
        lab = list(range(len(rows)))
        for _ in rows:
            for i in range(len(rows)):
                for j in range(len(rows)):
                    if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                        lab[i] = lab[j] = min(lab[i], lab[j])
        want = [min((rows[j][0] for j in range(len(rows)) if lab[j] == lab[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
        assert got == sorted((fp, i or 0, w) for (i, fp), w in zip(rows, want))


def test_components_by_rounds_equal_one_task(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "src long, dst long")
    one, many = ({r.node: r.component for r in components(df, task_links=n).collect()} for n in (10**6, 10))
    assert one == many and one[1040] == 1000
    assert components(df.limit(0)).collect() == []


def test_a_hot_head_is_cut_without_losing_a_link(spark):
    """Fingerprints of one head, in chunks: the components are those of one task."""
    from quern.llm.common import components

    rng = np.random.default_rng(4)
    base = (np.uint64(0xABCD) << np.uint64(48)) | rng.integers(0, 1 << 48, 60_000, dtype=np.uint64)
    near = base[:20_000] ^ (np.uint64(1) << rng.integers(0, 48, 20_000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 48, 20_000, dtype=np.uint64))
    keys = np.unique(np.r_[base, near, near[:5000] ^ np.uint64(7)])
    fps = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "fp long")

    def classes(task_keys):
        found = components(simhash.links(fps, 3, task_keys)).collect()
        by = {}
        for r in found:
            by.setdefault(r.component, set()).add(r.node)
        return sorted(map(sorted, by.values()))

    whole = classes(10**9)
    assert len(whole) > 10_000 and classes(10_000) == whole == classes(33_333)
