"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import registry

SMALL = "/root/testdata/sf0.001"
#: Queries over the same blended search as others here; the driver's gate runs them too.
SAME = {"heuristic_score", "rerank_topk", "filter_relevant", "noul_gate", "eval_recall_mrr", "token_bench_summary", "rrf_hybrid_topk", "doc_length", "doc_freq", "idf"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for file in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return db


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if n not in SAME])
def test_query(spark, tables, name):
    rows = registry.QUERIES[name](spark, SMALL)
    wanted = tables.execute(f"SELECT {', '.join(rows.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in rows.collect()))) == sorted(map(repr, wanted))


def test_rows_are_there(spark, tables):
    """Queries whose rows would be few by chance find some here."""
    for name in ("markdown_chunks", "section_chunks", "chunk_code_files", "find_references", "project_resolve", "embed_need"):
        assert tables.execute(f"SELECT count(*) FROM ({registry.ORACLES[name]})").fetchone()[0] > 10


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    bm25 = plan_of(registry.QUERIES["bm25_topk"](spark, SMALL))
    assert "CartesianProduct" not in bm25 and "WindowGroupLimit" in bm25
    for name in ("grep_cost", "eval_recall_mrr"):
        assert "CartesianProduct" not in plan_of(registry.QUERIES[name](spark, SMALL))
    scan = plan_of(registry.QUERIES["file_manifest"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in scan
    found = plan_of(registry.QUERIES["vector_topk"](spark, SMALL))
    assert "Join" not in found and "WindowGroupLimit" in found
