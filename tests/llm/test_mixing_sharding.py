import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest

from quern.llm import mixing, sharding
from quern.llm.common import ranked


def brute_schedule(weights, blocks):
    """Slot by slot, the released block with the earliest deadline: (source, j, release, deadline, slot)."""
    total, names = sum(map(Fraction, weights.values())), sorted(weights, key=lambda s: (s is not None, s or ""))
    share = {s: Fraction(weights[s]) / total for s in names}
    done, out, t = Counter(), [], 0
    while any(done[s] < blocks.get(s, 0) for s in names):
        free = [(ceil((done[s] + 1) / share[s]), i, s, floor(done[s] / share[s])) for i, s in enumerate(names) if done[s] < blocks.get(s, 0) and floor(done[s] / share[s]) <= t]
        if free:
            deadline, _, s, release = min(free)
            out.append((s, done[s], release, deadline, t))
            done[s] += 1
        t += 1
    return out


def brute_mix(sizes, weights, block_rows):
    out = []
    for s, j, *_ in brute_schedule(weights, {s: -(-n // block_rows) for s, n in sizes.items()}):
        out += [s] * min(block_rows, sizes[s] - j * block_rows)
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {None: 0.001, "x": 7, "y": 1.3, "z": 0.4}, {f"s{i}": 1 + i % 7 for i in range(30)}])
def test_schedule_equals_brute_force(weights):
    blocks = {s: 40 + 7 * i for i, s in enumerate(weights)}
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    got = mixing.earliest_first([weights[s] for s in names], [blocks[s] for s in names])
    assert [(names[i], *x) for i, *x in got] == brute_schedule(weights, blocks)


def test_mix_places_every_row_as_brute_force_does(spark):
    rng = random.Random(1)
    sizes = {"a": 700, "b": 90, None: 41, "d": 1}
    rows = [(i, f"t{rng.random()}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(5, rows[5][1], "a")] * 3 + [(None, None, "b")]
    sizes["a"] += 3
    sizes["b"] += 1
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, slot string")
    weights = {"a": 0.2, "b": 0.5, None: 0.2, "d": 0.1, "unused": 0.1}
    got = mixing.mix(docs, weights, block_rows=7).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert [r.source for r in sorted(got, key=lambda r: r.position)] == brute_mix(sizes, weights, 7)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    out = mixing.reorder(docs, weights, block_rows=7)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter((*r, "x") for r in rows)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1})
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.reorder(docs.limit(0)).collect() == []


@pytest.mark.parametrize("weights", [{"a": 12.5, "b": 987.5}, {"hot": 0.995, **{f"s{i}": 0.0001 for i in range(50)}}, {"a": 2**0.5, "b": 3**0.5, None: 0.01}])
def test_whole_run_stays_within_one_block_of_the_weights(weights):
    total, slots = sum(weights.values()), 30_000
    names = list(weights)
    found = np.array(list(mixing.earliest_first(list(weights.values()), [int(w / total * slots) + 1 for w in weights.values()])), np.int64)
    run = {s: found[found[:, 0] == i][:, 2:].T for i, s in enumerate(names)}
    used = found[:, 4]
    assert len(set(used.tolist())) == len(used)
    for s, (release, deadline, slot) in run.items():
        assert (release <= slot).all() and (slot < deadline).all()
        j, share = np.arange(len(slot)), weights[s] / total
        # the furthest ahead after a block, the furthest behind before it
        assert (j + 1 - (slot + 1) * share < 1 + 1e-9).all() and (j - slot * share > -1 - 1e-9).all()


def test_mix_follows_the_given_weights_over_many_periods(spark):
    n = {"a": 200, "b": 15_800}
    docs = spark.range(sum(n.values())).selectExpr("id as doc_id", "string(id) as text", f"if(id < {n['a']}, 'a', 'b') as source")
    got = mixing.mix(docs, {"a": 12.5, "b": 987.5}, block_rows=1).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert {r.source: r.target for r in got} == {"a": 0.0125, "b": 0.9875}
    assert all(abs(r.block - r.slot * r.target) <= 1 and r.release <= r.slot < r.deadline for r in got)


def test_many_sources_in_pieces(spark):
    n = 10_000
    rows = {f"s{i}": 1 + i % 3 for i in range(n)}
    weights = {s: 1 + i % 11 for i, s in enumerate(rows)}
    plan = mixing.Plan.of(spark, weights, rows, 2, piece_blocks=1000)
    order, at = {}, 0
    names = sorted(rows)
    for i, j, release, deadline, t in mixing.earliest_first([weights[s] for s in names], [-(-rows[s] // 2) for s in names]):
        order[i, j] = release, deadline, t, at
        at += min(2, rows[names[i]] - 2 * j)
    source = np.repeat(np.arange(n), [rows[s] for s in names])
    rank = np.concatenate([np.arange(rows[s]) for s in names])
    got = np.stack(plan.place(source, rank), 1).tolist()
    for s, r, (block, *found, position) in zip(source.tolist(), rank.tolist(), got):
        assert block == r // 2 and (*found, position - r % 2) == order[s, block]
    assert sorted(x[-1] for x in got) == list(range(len(rank)))


def test_equal_rows_over_several_tasks(spark):
    docs = spark.range(3000).selectExpr("if(id < 2500, 7, id) as doc_id", "if(id < 2500, 'same', string(id)) as h").selectExpr("doc_id", "xxhash64(h) as h")
    got = ranked(docs, [], ["h", "doc_id"], "rank", bucket_rows=8, copies=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(3000))
    assert [r.h for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.h for r in got)
    assert Counter(r.doc_id for r in got)[7] == 2500


def test_allot_equals_a_walk_of_single_keys():
    rng = np.random.default_rng(2)
    _, owner = sharding.ring(5, 8)
    counts = rng.integers(0, 30, len(owner))
    room = sharding.capacities(int(counts.sum()), 5, 1.0)
    lists = sharding.allot(counts, owner, room)
    used = Counter()
    for arc, x in enumerate(lists):
        assert sum(k for _, k in x) == counts[arc]
        for s, k in x:
            used[s] += k
        # clockwise: an earlier node's shard is left behind only once it is full
        walk = [int(owner[(arc + i) % len(owner)]) for i in range(len(owner))]
        assert [s for s, _ in x] == sorted({s for s, _ in x}, key=walk.index)
    assert [used[s] for s in range(5)] == room.tolist()


def test_shards_are_even_gapless_and_move_little(spark):
    rng = random.Random(1)
    rows = [(i, "copy" if i % 3 == 0 else f"é{rng.random()}", "s") for i in range(4000)] + [(7, "copy", "s")] * 2 + [(None, None, None)] * 5
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")
    got = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 16
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    one = next(r for r in got if r.doc_id is None)
    assert (one.size, one.text_crc32) == (1, 0)
    more = {(r.doc_id, r.k1): r.shard for r in sharding.shard(docs, shards=17).collect()}
    moved = np.mean([more[r.doc_id, r.k1] != r.shard for r in got])
    assert moved < 0.35
    loose = Counter(r.shard for r in sharding.shard(docs, load=1.1).collect())
    assert max(loose.values()) <= np.ceil(1.1 * len(rows) / 16)
    assert sharding.shard(docs.limit(0)).collect() == []
