"""The registered queries: contract columns, whole tables, and DuckDB where it can say the same."""

import hashlib
import zlib

import pytest
from oracle import compare, connect

from plumbline.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op3_spotsigs": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4_toxicity_kn": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_quality_crf": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
}


def test_all_ten_are_there():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = "conversations" if name.startswith("op8_") else "documents"
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    assert COLUMNS.get(name, {}).items() <= dict(df.dtypes).items()
    rows = df.collect()
    assert len(rows) == source.count()
    if table == "documents":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in source.collect())
    if name in ("op4_toxicity_kn", "op6_quality_crf"):
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == (r.score >= (0.5 if name.startswith("op4") else 0.3)) and 0 <= r.score <= 1
    if name == "op3_spotsigs":
        texts = {r.doc_id: r.text for r in source.collect()}
        order = sorted(texts, reverse=True)
        for i, d in enumerate(order):
            t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
            r = next(r for r in rows if r.doc_id == d)
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_duckdb_says_the_same(spark, name):
    compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])
