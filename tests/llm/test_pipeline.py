from collections import Counter, defaultdict

import corpus_pipeline
from quern.llm import decontaminate, mixing, toxicity

from tests.llm.test_mixing_sharding import brute_mix

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows, least):
    sets, parent = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if rows[i].text == rows[j].text or u and len(sets[i] & sets[j]) >= least * u:
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x].doc_id)
                parent[b] = a
    return {rows[i].doc_id: rows[find(i)].doc_id for i in range(len(rows))}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs.collect()
    start = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id for r in toxicity.classify(start, spark.read.parquet(f"{SF}/labels.parquet")).where("not toxic").collect()}
    assert {r.doc_id for r in seen["toxicity"]} == found
    left = {r.doc_id for r in seen["simhash near duplicates"]}
    strict, loose = classes(seen["toxicity"], 0.8), classes(seen["toxicity"], 0.76)
    assert set(loose.values()) <= left and set(strict.values()) <= left
    assert len(left - set(strict.values())) <= 1  # a pair that no table brought together
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in seen["decontamination"]}
    held = {r.doc_id for r in seen["simhash near duplicates"] if any(b in decontaminate.normal(r.text) for b in bench)}
    assert not clean & held and len(left - clean - held) <= 1
    assert Counter(r.doc_id for r in seen["mixing"]) == Counter(clean)
    sizes = Counter(r.source for r in seen["decontamination"])
    want = brute_mix(sizes, {s: n**0.5 for s, n in sizes.items()}, mixing.BLOCK_ROWS)
    source = {r.doc_id: r.source for r in seen["mixing"]}
    last = seen["sharding"]
    assert [source[r.doc_id] for r in sorted(last, key=lambda r: r.mix_position)] == want
    assert [r.source for r in docs.sparkSession.read.parquet(f"{tmp_path}/3").collect()][:3] == want[:3]
    by = defaultdict(list)
    for r in last:
        by[r.shard].append((r.slot, r.mix_position))
    assert all([s for s, _ in sorted(x)] == list(range(len(x))) and sorted(x) == sorted(x, key=lambda y: y[1]) for x in by.values())
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert corpus_pipeline.run(spark, SF).count() == len(last)
