"""Repairs against an independent search: the least (cost, audit) by state, row after row."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from quern.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, copies int, p string, chunk string, rows string, first string, k1 string, stands string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """rows: (initial, gone, truncated); the audit by forward search over (cost, audit)."""
    inserted = lambda best: [best := {q: min(x for x in [best.get(q)] + [(best[p][0] + 5, best[p][1] + "I") for p in best if NEXT[p] == q] if x) for q in {*best, *(NEXT[p] for p in best)}} for _ in range(3)][-1]  # noqa: E731, F841
    best = {"": (0, "")}
    for initial, gone, cut in rows:
        out = defaultdict(list)
        for p, (cost, audit) in inserted(best).items():
            out[p].append((cost + 2, audit + "D"))
            if not gone:
                out[NEXT[p]].append((cost + 1 + 5 * cut, audit + "R"))
                if initial == NEXT[p] or p == "" and initial == "s":
                    out[initial].append((cost + 5 * cut, audit + "K"))
        best = {q: min(x) for q, x in out.items()}
    best = inserted(best)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    """rows: (turn, role, text, copies) of one conversation, in any order; nothing in one turn twice but copies."""
    out, seen = [], set()
    for turn, role, text, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out += [(turn, " " if role is None else role, " " if text is None else text)] * n
    faults = []
    for _, role, text in out:
        faults.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, *_ in out if t is not None}
    cost, audit = cheapest([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(out, faults)])
    lines, state, i = [], "", 0
    for letter in audit:
        role, text = out[i][1:] if letter != "I" else ("", "")
        i += letter != "I"
        if letter != "D":
            state = role[:1] if letter == "K" else NEXT[state]
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df, copies="copies", **kw).collect()}
    want = defaultdict(list)
    for c, *r in rows:
        want[c].append(r)
    assert set(got) == set(want)
    for c in want:
        assert got[c] == brute(want[c]), c


def conversation(rng, c, n):
    turns = rng.sample(range(n * 2), n)
    roles = ["user", "assistant", "system", "tool", None, "", "u", " x"]
    out = []
    for i, t in enumerate(sorted(turns)):
        role = rng.choice(roles) if rng.random() < 0.3 else ["user", "assistant"][i % 2]
        text = rng.choice(["Same text.", "", " \n", None, "cut off", "Fine?", "Fine! \t", ".", "a"]) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}."
        out.append((c, None if i == 0 and rng.random() < 0.2 else t, role, text, rng.choice([1, 1, 1, 1, 2, 0, 3])))
    return out


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = [r for c in range(400) for r in conversation(rng, c, rng.randrange(1, 12))]
    rows += [(None, 0, "user", "Hm?", 1), (None, 1, "assistant", "Well.", 1), (-1, None, None, None, 1), (-2, 5, "user", "gone", 0), (-3, 0, "user", "x" * 3_000_000 + ".", 1), (-3, 1, "assistant", "y" * 3_000_000, 1), (-3, 2, "user", "z" * 3_000_000, 1)]
    check(spark, rows)


@pytest.mark.parametrize("chunk", [1, 3, 16])
def test_long_conversations_are_cut_without_a_trace(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [r for c in range(12) for r in conversation(rng, c, rng.choice([1, 4, 60, 200]))]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        df = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA)
        pieces = [r for r in C.repair(df, copies="copies").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = defaultdict(list)
    for c, *r in rows:
        want[c].append(r)
    assert {r.conv_id: tuple(r)[1:] for r in pieces} == {c: brute(x) for c, x in want.items()}


def test_one_row_a_million_times(spark):
    df = spark.createDataFrame([(1, 0, "user", "Again.", 1_000_000), (1, 1, "assistant", "No.", 1)], "conv_id long, turn long, role string, text string, copies int")
    (r,) = C.repair(df, copies="copies").collect()
    assert (r.duplicate, r.illegal, r.cost, len(r.audit)) == (999_999, 999_999, 2 * 999_999, 1_000_001) and r.audit[0] == r.audit[-1] == "K"


def test_empty(spark):
    assert C.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string")).collect() == []


def test_distances_are_shortest():
    rng = random.Random(2)
    for _ in range(200):
        rows = bytes(rng.randrange(8) for _ in range(rng.randrange(12)))
        ends = tuple(rng.choice([0, 3, 9, C.FAR]) for _ in range(3)) + (rng.randrange(20),)
        n = len(rows)
        want = [C.FAR] * (4 * n) + list(ends)
        for _ in range(4 * n + 8):  # Bellman-Ford
            for v in range(4 * n + 4):
                place, q = v >> 2, v & 3
                nexts = [(5, 4 * place + C.FORCED[q])] + ([(c, 4 * place + 4 + to) for _, c, to in C.arcs(q, rows[place])] if place < n else [])
                want[v] = min([want[v]] + [c + want[u] for c, u in nexts if want[u] < C.FAR])
        assert C.distances(rows, ends) == want
