"""Nearest vectors: exact against numpy, approximate with measured recall, hot lists."""

import numpy as np
import pytest

from quarry.operators import vectors as V


def table(spark, points, ids=None):
    rows = [(int(i), None if p is None else [float(x) for x in p]) for i, p in zip(ids if ids is not None else range(len(points)), points, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def unit(n, dim=8, seed=0, centres=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dim))
    return np.float32(x / np.linalg.norm(x, axis=1, keepdims=True))


def plain(points, asked, k):
    scores = asked.astype(float) @ points.astype(float).T
    return {(q, int(i)) for q in range(len(asked)) for i in sorted(range(len(points)), key=lambda j: (-round(float(scores[q, j]), 9), j))[:k]}


def pairs(hits):
    return {(r["query_id"], r["chunk_id"]) for r in hits.collect()}


@pytest.mark.parametrize("block", [7, 4096])
def test_exact(spark, block):
    points, asked = unit(500), unit(20, seed=1)
    points[100:130] = points[100]  # ties
    known = table(spark, [*points, None])
    queries = table(spark, asked).toDF("query_id", "query_vec")
    got = V.exact_topk(known, queries, 10, block)
    assert pairs(got) == plain(points, asked, 10) and got.count() == 200
    assert V.exact_topk(known, queries.limit(0), 10).count() == 0 and V.exact_topk(known.limit(0), queries, 10).count() == 0


def test_lists_have_recall(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 100)  # lists are cut into parts
    points, asked = unit(3000, 16, 2), unit(60, 16, 3)
    known, queries = table(spark, [*points, None]), table(spark, asked).toDF("query_id", "query_vec")
    lists = V.Lists(known, sample=600)
    assert 1 <= lists.probes < len(lists.centres) and lists.rows.count() == 3000 and lists.parts.agg({"parts": "max"}).first()[0] > 1
    found, exact = lists.search(queries, 10), V.exact_topk(known, queries, 10)
    row = V.recall(found, exact).first()
    assert row["n"] == 600 and row["recall"] >= 0.9
    assert V.recall(lists.search(queries, 10, probes=10**6), exact).first()["recall"] == 1.0
    assert V.Lists(known.limit(0)).search(queries, 10).count() == 0 and lists.search(queries.limit(0), 10).count() == 0
