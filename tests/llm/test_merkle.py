"""The manifest against trees built whole."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle as M

SCHEMA = "doc_id long, grp string, leaf binary, shown binary, g string, j long, n string, level string, path string"


def up(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256("".join(out[-1][i : i + 2]).encode()).hexdigest() for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, j):
    return [(j >> k, level[j >> k ^ 1]) if j >> k ^ 1 < len(level) else (j >> k, "") for k, level in enumerate(levels[:-1])]


def fold(x, steps):
    for j, other in steps:
        x = hashlib.sha256((other + x if j & 1 else x + other).encode()).hexdigest()
    return x


def brute(rows):
    groups = defaultdict(list)
    for doc_id, grp, leaf, shown in rows:
        groups[grp].append((doc_id is not None, doc_id or 0, leaf.hex(), (shown or leaf).hex()))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([x[2] for x in sorted(groups[g])]) for g in names}
    crown = up([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for j, (known, doc_id, leaf, shown) in enumerate(sorted(groups[g])):
            steps = way(trees[g], j) + way(crown, k)
            root = crown[-1][0]
            out.append((doc_id if known else None, leaf, trees[g][-1][0], root, hashlib.sha256("".join(x for _, x in steps).encode()).hexdigest(), fold(shown, steps), fold(shown, steps) == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7, *["clash"] * 3) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in M.manifest(df).collect()), key=str) == brute(rows)


def leaf(rng):
    return rng.randbytes(32)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [1, 1, 1], [5], [3, 7, 1, 64, 65], [1000, 1, 13]])
def test_trees_of_all_shapes(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i, [None, "b", "ä", "", "z"][k], leaf(rng), leaf(rng) if i % 7 == 0 else None) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_many_rounds(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    rng = random.Random(levels)
    check(spark, [(rng.randrange(10**9), rng.choice(["a", "a", "a", "b", None]), leaf(rng), leaf(rng) if i % 5 == 0 else None) for i in range(150)])


def test_awkward_rows(spark):
    one, two = b"\1" * 32, b"\2" * 32
    check(spark, [(None, None, one, None), (None, None, one, None), (None, None, two, None), (3, "x", one, two), (3, "x", one, one), (3, "x", two, None), (-5, "X", one, None), (2**62, "", two, one)])
    check(spark, [(i % 3, "hot", one, None) for i in range(300)])
    assert M.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_leaves_are_encoded_by_length(spark):
    df = spark.createDataFrame([(1, "ä", None, "t" * 1_000_000), (None, "", "en", "")], "a long, b string, c string, d string")
    got = [bytes(r[0]).hex() for r in df.select(M.digest(*map(F.col, "abcd"))).collect()]
    want = ["1:12:ä-1000000:" + "t" * 1_000_000, "-0:2:en0:"]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in want]


def test_frontiers_take_children_in_any_order():
    rng = random.Random(1)
    for n in (1, 2, 3, 11, 40):
        nodes = [leaf(rng) for _ in range(n)]
        want = up([x.hex() for x in nodes])[-1][0]
        for _ in range(5):
            f, order = M.Frontier(n, 99), list(range(n))
            rng.shuffle(order)
            for j in order:
                f.arrive(0, j, nodes[j])
            assert [x.hex() for _, _, x in f.unresolved()] == [want]


def test_a_changed_record_fails_and_others_pass(spark):
    from quern.llm import queries

    rows = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    import zlib

    n = {r.doc_id: r.n_chars for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or n[r.doc_id] is None) for r in rows)
