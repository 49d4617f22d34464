"""Every corpus query over the smallest tables: its columns, types and one row for each of its table's rows."""

import pytest

from quern.llm import queries

SF = "/root/testdata/sf0.001"
WANT = {
    "op1": ("documents", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    "op2": ("documents", {"doc_id": "bigint", "contaminated": "boolean", "item_ids": "array<bigint>"}),
    "op3": ("pages", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}),
    "op4": ("documents", {"doc_id": "bigint", "source": "string", "release": "bigint", "deadline": "bigint", "slot": "bigint", "position": "bigint"}),
    "op5": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op6": ("documents", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}),
    "op7": ("documents", {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}),
    "op8": ("documents", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}),
    "op9": ("documents", {"doc_id": "bigint", "perplexity": "double", "kept": "boolean"}),
    "op10": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op11": ("documents", {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}),
    "op12": ("conversations", {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}),
    "op13": ("documents", {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}),
}


def test_all_are_registered():
    assert sorted(n.split("_")[0] for n in queries.queries() if n.startswith("op")) == sorted(WANT)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.startswith("op")])
def test_columns_and_rows(spark, name):
    table, columns = WANT[name.split("_")[0]]
    df = queries.queries()[name](spark, SF)
    assert {c: t for c, t in df.dtypes if c in columns} == columns
    rows = df.collect()
    key = {"pages": "page_id", "conversations": "conv_id"}.get(table, "doc_id")
    there = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in (there.distinct() if key == "conv_id" else there).collect())
    if name.startswith("op5"):
        assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
    if name.startswith("op1_"):
        assert not any(r.kept and r.base_failed for r in rows) and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    from tests.oracle import connect, differences

    assert differences(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None
