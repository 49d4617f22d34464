import random
from collections import Counter

import numpy as np

from quern.llm import mixing
from quern.llm import near_text as N


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def made(rng, words=4000):
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(words)}" for _ in range(rng.choice([12, 60, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            t = list(base)
            for _ in range(max(1, int(len(t) * rng.choice([0.002, 0.01, 0.06, 0.3])))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(words)}"
            texts.append(" ".join(t))
    return texts


def test_classes_find_near_copies(spark, make_docs):
    rng = random.Random(2)
    texts = made(rng)
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    comp = {r.doc_id: r.component for r in N.classes(docs).collect()}
    far = near = hit = 0
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            s = jaccard(texts[i], texts[j])
            if s >= 0.75:
                parent[find(i)] = find(j)
            if s >= 0.8:
                near += 1
                hit += comp[i] == comp[j]
    for i in range(len(texts)):
        for j in range(i):
            far += comp[i] == comp[j] and find(i) != find(j)
    assert near > 20 and hit >= 0.97 * near and far == 0


def test_keep_one_and_odd_inputs(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(999)}" for _ in range(300)]
    near = list(base)
    near[7] = "changed"
    a, b, c = " ".join(base), " ".join(near), " ".join(f"q{i}" for i in range(40))
    rows = [(5, a, "x"), (3, b, "y"), (9, a, "z"), (4, c, "x"), (4, c, "x"), (None, c, "n"), (None, None, None), (None, "", "e"), (7, " \n", "w"), (8, "one two", "s"), (6, "One Two", "s")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, k1 string, component int")
    got = N.keep_one(docs)
    assert got.dtypes == docs.dtypes
    left = Counter(r.doc_id for r in got.collect())
    assert left == Counter([3, 4, None, 7, 6])
    assert N.keep_one(docs.limit(0)).collect() == []


def test_unlike_short_texts_of_one_fingerprint_stay_apart(spark, make_docs):
    hashes, seen = N._Hashes(), {}
    texts = [f"a{i} b{i}" for i in range(3000)]
    for t in texts:  # place and sign are all that a single shingle leaves
        h = int(N.shingle_set(t, 5, hashes)[0])
        seen.setdefault((h >> 52, h & 1), []).append(t)
    alike = next(x for x in seen.values() if len(x) > 1)[:2]
    bits = N.wide_bits([N.shingle_set(t, 5, hashes) for t in alike])
    assert (bits[0] == bits[1]).all()
    docs = make_docs([(i, t, "s") for i, t in enumerate([*alike, alike[0].upper()])])
    comp = {r.doc_id: r.component for r in N.classes(docs).collect()}
    assert comp[0] == comp[2] != comp[1]
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == [0, 1]


def family(rng, n, share):
    """n texts that keep each word of one base with the probability share, and for each of a tenth of them a near copy."""
    base = [f"b{i}" for i in range(300)]
    out = []
    for _ in range(n):
        at, t = rng.randrange(300), list(base)
        for i in range(int(300 * (1 - share))):
            t[(at + i) % 300] = f"n{rng.randrange(10**9)}"
        out.append(t)
    for t in out[: n // 10]:
        t = list(t)
        for i in rng.sample(range(300), 3):
            t[i] = "changed"
        out.append(t)
    return [" ".join(t) for t in out]


def test_near_copies_within_a_family_of_unlike_texts(spark, make_docs):
    rng = random.Random(8)
    texts = family(rng, 400, 0.86)
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in ((1, 2), (3, 50), (7, 90))]
    assert max(far) < 0.8 and len(pairs) >= 40
    comp = {r.doc_id: r.component for r in N.classes(docs).collect()}
    assert all(comp[i] == comp[j] for i, j in pairs)
    # large groups in chunks, each pair of which is a task's, to the same end
    cut = {r.doc_id: r.component for r in N.classes(docs, task_texts=50).collect()}
    names = lambda c: {frozenset(i for i in c if c[i] == x) for x in set(c.values())}
    assert names(cut) == names(comp)


def test_tables_follow_the_number_of_texts():
    for n in (1, 10**4, 10**7, 10**10):
        t = N.Tables.of(n, 0.8)
        p = 1 - N.differing(0.8) - N.FOLD_SPREAD
        assert (1 - p ** t.columns.shape[1]) ** len(t.columns) <= N.MISSED and n / 2 ** t.columns.shape[1] <= N.GROUP_TEXTS
    assert len(t.columns) < 2**15


def test_stored_sets_come_back(tmp_path):
    rng = np.random.default_rng(1)
    sets = N.Sets(N.Store(str(tmp_path)))
    held = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 63, 64, 65, 1000)]
    refs, parts, at = [], [], 0
    for s in held:
        refs.append(7 << 24 | at)
        parts += [np.full(N.WORDS, len(s), np.uint64), N.stored(s)]
        at += N.WORDS + len(parts[-1])
    sets.store.save("sets-7", np.concatenate(parts))
    assert (sets.fingerprints(np.array(refs))[:, 0] == [len(s) for s in held]).all()
    # every stored set with the same, with one hash more, and with others
    more = [np.sort(np.r_[s, s[-1] ^ np.uint64(1 << 40)]) for s in held]
    back = [sets.set(r) for r in refs]
    every = [*back, *held, *more]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(15), np.arange(15)))
    for similarity in (1.0, 0.95, 0.5):
        got = N.reach(every, x, y, similarity)
        for i, j, ok in zip(x.tolist(), y.tolist(), got.tolist()):
            a, b = (set(([*held, *held, *more][v] >> np.uint64(16)).astype(np.uint32).tolist()) if len([*held, *held, *more][v]) >= 60 else set(held[v % 5].tolist() if v < 10 else more[v - 10].tolist()) for v in (i, j))
            if max(len(a), len(b)) >= 60:
                assert ok == (len(a & b) >= similarity * len(a | b)) or min(len(a), len(b)) == 1
    one = [np.array([5 << 50], np.uint64), np.array([(5 << 50) + 1], np.uint64)]
    assert N.reach(one, np.array([0, 0]), np.array([0, 1]), 0.8).tolist() == [True, False]


def test_rows_of_one_64_bit_key_are_told_apart(spark, monkeypatch):
    """With a first half that is the same for all rows, the second alone names them."""
    rows = [(i, f"text {i} of many words that are not alike {i * 7} {i * 13} {i * 17}", str(i % 3)) for i in range(60)] + [(7, "text 7 again", "x"), (7, "text 7 again", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    want = sorted(map(str, N.keep_one(docs).collect()))
    places = [r.doc_id for r in mixing.reorder(docs).collect()]
    monkeypatch.setattr(N, "half", lambda seed, *c, real=N.half: F.lit(5).cast("long") if seed == 1 else real(seed, *c))
    assert sorted(map(str, N.keep_one(docs).collect())) == want and len(want) == 62
    assert [r.doc_id for r in mixing.reorder(docs).collect()] == places


def test_sets_are_read_a_part_at_a_time_and_never_mapped(tmp_path, monkeypatch):
    """A worker that compares sets all over the files holds some of them, however large the files are."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    held = [np.sort(rng.choice(base, n, replace=False)) for n in [2900, 2800, 1400, 60, 50] * 8]
    sets, refs = N.Sets(N.Store(str(tmp_path))), []
    for f in range(8):  # files of five sets each
        parts, at = [], 0
        for s in held[5 * f : 5 * f + 5]:
            refs.append(f << 24 | at)
            parts += [np.full(N.WORDS, len(s), np.uint64), N.stored(s)]
            at += N.WORDS + len(parts[-1])
        sets.store.save(f"sets-{f}", np.concatenate(parts))
    refs = np.array(refs)
    assert sets.fingerprints(refs)[:, 0].tolist() == [len(s) for s in held]
    every = [sets.set(r) for r in refs.tolist()]
    with open("/proc/self/maps") as maps:
        assert str(tmp_path) not in maps.read()
    x, y = (v.ravel() for v in np.meshgrid(np.arange(40), np.arange(40)))
    read = []
    monkeypatch.setattr(N, "READ_WORDS", 8000)
    monkeypatch.setattr(N, "reach", lambda s, *a, real=N.reach: read.append(sum(v.nbytes for v in s) // 8) or real(s, *a))
    got = sets.alike(refs[x], refs[y], 0.8)
    assert 0 < max(read) <= 8000 < sum(v.nbytes for v in every) // 8
    monkeypatch.undo()
    assert (got == N.reach(every, x, y, 0.8)).all() and 0 < got.sum() < len(got)
    assert sets.alike(refs[:0], refs[:0], 0.8).tolist() == []
