import random
from collections import Counter

from quern.llm import line_runs

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(texts, least):
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_drop_frequent_equals_brute_force(spark, make_docs):
    rng = random.Random(2)
    pool = ["Alpha É", "  alpha É\r", "beta", "BETA ", "gamma\x0b", " nbsp", "", " ", "only", "İx"]
    texts = ["\n".join(rng.choice(pool + [f"u{rng.randrange(10**6)}"] * 8) for _ in range(rng.randrange(0, 9))) for _ in range(120)] + [None, "", "\n", "beta\n" * 50]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_runs.drop_frequent(make_docs(rows), 10).collect()}
    assert got == dict(enumerate(brute(texts, 10)))


def test_empty_null_and_repeated_rows(spark, make_docs):
    assert line_runs.drop_frequent(make_docs([])).collect() == []
    rows = [(1, "x\ny", "s")] * 10 + [(None, "X\nz", None)]
    got = Counter(tuple(r) for r in line_runs.drop_frequent(make_docs(rows)).collect())
    assert got == {(1, "", 2, 2): 10, (None, "z", 2, 1): 1}


def test_runs_keep_levels_and_first_seen(spark, make_docs):
    store = line_runs.LineRuns(spark)
    seen = []
    for i in range(5):
        kept = line_runs.first_seen(store, make_docs([(i, f"same\nown{i}", "s")]))
        seen.append(sorted(r.pos for r in kept.collect()))
    assert seen == [[0, 1]] + [[1]] * 4
    assert [x is not None for x in store.levels] == [True, False, True]
    assert sorted(r.n for r in store.counts().collect()) == [1, 1, 1, 1, 1, 5]
    store.close()


def ancestors(plan, n):
    """The lines above a line of a plan, nearest first."""
    deep, out = (lambda x: len(x) - len(x.lstrip(" :+-"))), []
    least = deep(plan[n])
    for x in reversed(plan[:n]):
        if deep(x) < least:
            out.append(x)
            least = deep(x)
    return out


def test_batches_count_together_without_moving_old_runs(spark, make_docs):
    rng = random.Random(5)
    texts = ["\n".join(f"l{rng.randrange(60)}" for _ in range(5)) for _ in range(80)]
    store = line_runs.LineRuns(spark, buckets=4)
    for at in range(0, 80, 16):
        rows = [(i, texts[i], "s") for i in range(at, at + 16)]
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_runs.drop_frequent(make_docs(rows), 8, store=store).collect()}
        assert got == {i: x for i, x in enumerate(brute(texts[: at + 16], 8)) if i >= at}
    assert [x is not None for x in store.levels] == [True, False, True]
    # neither a new run nor its keys' anti-join moves a row of an old run
    run = store.write(store.count(line_runs.explode_lines(make_docs([(1, "l1\nnew", "s")]))))
    for df in (store.totals(run), store.unseen(line_runs.explode_lines(make_docs([(1, "l1\nnew", "s")]))), line_runs._merged(*store.runs())):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        scans = [n for n, x in enumerate(plan) if "Bucketed: true" in x]
        assert scans
        for n in scans:
            above = ancestors(plan, n)
            assert not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "SortMergeJoin" in x)])
    store._drop(run)
    mine = {x for x in store.levels if x}
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    assert len(mine) == 2 and mine <= tables()
    store.close()
    assert not mine & tables()


def test_a_table_in_batches_tells_what_was_seen_before(spark):
    rng = random.Random(7)
    ids = [rng.randrange(1000) for _ in range(150)] + [None, -(2**62), 2**62]
    texts = ["\n".join(rng.choice(["", "Same", " same ", *(f"l{rng.randrange(300)}" for _ in range(4))]) for _ in range(rng.randrange(7))) for _ in ids]
    least, most = min(x for x in ids if x is not None), max(x for x in ids if x is not None)
    docs = spark.createDataFrame(list(zip(ids, texts, ["clash"] * len(ids))), "doc_id long, text string, batch string")
    for some, low, high in ((docs.where("doc_id between 0 and 999 or doc_id is null"), 0, 999), (docs, least, most)):
        rows = [tuple(r)[:2] for r in some.collect()]
        low, high = min(i for i, _ in rows if i is not None), max(i for i, _ in rows if i is not None)
        batch = lambda i: 0 if i is None else (i - low) // ((high - low) // 4 + 1)  # noqa: E731, B023
        born = {}
        for i, t in rows:
            for k in map(key, t.split("\n")):
                born[k] = min(born.get(k, 9), batch(i))
        want = Counter((i, *x, sum(bool(key(k)) and born[key(k)] < batch(i) for k in t.split("\n"))) for (i, t), x in zip(rows, brute([t for _, t in rows], 5)))
        got = Counter(tuple(r) for r in line_runs.drop_frequent(some, 5, tell_seen=True).collect())
        assert got == want


def test_what_a_run_has_seen_is_told_without_moving_a_row(spark, make_docs):
    store = line_runs.LineRuns(spark, buckets=4)
    for i in range(3):
        store.add(store.write(store.count(line_runs.explode_lines(make_docs([(i, f"same\nl{i}", "s")])))))
    run = store.write(store.count(line_runs.explode_lines(make_docs([(9, "same\nl1\nnew", "s")]))))
    found = store.seen(run)
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
    store._drop(run)
    store.close()


def test_a_store_that_grows_gets_more_buckets(spark, make_docs):
    store = line_runs.LineRuns(spark, buckets=2, bucket_rows=10)
    for i in range(4):
        store.add(store.write(store.count(line_runs.explode_lines(make_docs([(i, "same\n" + "\n".join(f"l{i}-{k}" for k in range(30)), "s")])))))
    assert store.buckets == 32 and [x is not None for x in store.levels] == [False, False, True]
    assert sorted(r.n for r in store.counts().collect()) == [1] * 120 + [4]
    store.close()
