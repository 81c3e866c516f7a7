"""Every registered query on the smallest tables: columns, types and folds of its contract, and the SQL of those that have one."""

import zlib
from pathlib import Path

import duckdb
import pytest

from corvane.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_line_dedup": "doc_id bigint, n_lines int, n_removed int",
    "op9_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_all_are_registered():
    assert set(registry.queries()) == set(COLUMNS) | {"pipeline"} and set(registry.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    types = dict(df.dtypes)
    for part in COLUMNS[name].split(", "):
        column, kind = part.split()
        assert types[column] == kind, column
    rows = [r.asDict() for r in df.collect()]
    docs = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    if name not in ("op2_url_filter", "op4_nearest", "op7_packing", "op11_hard_negatives", "op12_spelling"):
        assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in docs)
    fold = {"op3_lm_score": 1, "op6_toxicity": 0}.get(name)
    if fold is not None:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == fold) for r in rows)
    if name == "op1_token_output":
        at = 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            assert r["start"] == at
            at += r["n_tokens"]
    if name == "op4_nearest":
        assert {r["query_id"] % 50 for r in rows} == {0} and all(1 <= r["rank"] <= 5 and r["query_id"] != r["vec_id"] for r in rows)
    if name == "op6_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name == "op7_packing":
        assert all(r["offset"] + r["length"] <= 2048 for r in rows) and sorted({r["doc_id"] for r in rows}) == sorted({d for d, _ in docs})
    if name == "op10_sharding":
        counts = [sum(r["shard"] == k for r in rows) for k in range(8)]
        assert max(counts) - min(counts) <= 1 and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
        assert sorted((r["doc_id"], r["text_crc32"], r["size"]) for r in rows) == sorted((d, zlib.crc32(t.encode()), len(t.encode()) + 1) for d, t in docs)
    if sql := registry.oracle_sql().get(name):
        want = duck.sql(sql)
        at = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(str([r[c] for c in sorted(want.columns)]) for r in rows) == sorted(str([r[i] for i in at]) for r in want.fetchall())
