"""The field against enumeration, scores against textbook recursions, and held-out accuracy."""

import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm._crf import BITS, PREFIXES, Field, tokens
from quarry.llm._words import buffers

SMALL = "/root/testdata/sf0.01"


def random_field(seed):
    rng = np.random.default_rng(seed)
    return Field(weights=rng.normal(0, 1, 1 << BITS).astype(np.float32), bias=-0.5, moves=rng.normal(0, 1, (2, 2)), first=rng.normal(0, 1, 2)), rng


def test_marginals_equal_enumeration():
    f, rng = random_field(3)
    features, starts = rng.integers(0, 1 << BITS, (9, len(PREFIXES))), np.array([0, 4])
    p, moves, first = f.marginals(features, starts, True)
    want_p, want_moves, want_first, e = np.zeros(9), np.zeros((2, 2)), np.zeros(2), f.scores(features)
    for low, high in ((0, 4), (4, 9)):
        weights, paths = [], list(itertools.product((0, 1), repeat=high - low))
        for path in paths:
            s = f.first[path[0]] + sum(e[low + k] for k, y in enumerate(path) if y) + sum(f.moves[a, b] for a, b in itertools.pairwise(path))
            weights.append(np.exp(s))
        for path, w in zip(paths, np.array(weights) / sum(weights), strict=True):
            want_p[low:high] += w * np.array(path)
            want_first[path[0]] += w
            for a, b in itertools.pairwise(path):
                want_moves[a, b] += w
    assert np.allclose(p, want_p) and np.allclose(moves, want_moves) and np.allclose(first, want_first)


def test_training_in_chunks_agrees():
    rng = np.random.default_rng(1)
    features, starts = rng.integers(0, 500, (900, len(PREFIXES))), np.array([0, 100, 130, 400, 401, 820])
    labels = features[:, 0] < 50
    whole, parts = Field().fit(features, starts, labels), Field().fit(features, starts, labels, chunk=64)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.moves, parts.moves) and np.allclose(whole.first, parts.first)
    assert ((whole.marginals(features, starts) > 0.5) == labels).mean() > 0.95


def plain_scores(model, texts):
    """Scores and spans of code points by textbook recursions, a text at a time."""
    out, f = [], model.field
    for text in texts:
        raw = (text or "").encode()
        parsed, features = tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        p = []
        if len(features):
            e, a = f.scores(features), np.exp(f.moves)
            forward = [np.exp(f.first) * [1, np.exp(e[0])]]
            for t in range(1, len(e)):
                v = forward[-1] @ a * [1, np.exp(e[t])]
                forward.append(v / v.sum())
            v = np.ones(2)
            back = [v]
            for t in range(len(e) - 1, 0, -1):
                v = a @ ([1, np.exp(e[t])] * v)
                v = v / v.sum()
                back.insert(0, v)
            p = [(x * y)[1] / (x * y).sum() for x, y in zip(forward, back, strict=True)]
        total, n = sum(p), len(p)
        x = np.array([np.log1p(total), max(p, default=0), np.log1p(100 * total / max(n, 1)), np.log1p(n), 1])
        spans = [(len(raw[: parsed.starts[k]].decode()), len(raw[: parsed.ends[k]].decode())) for k in range(n) if p[k] >= 0.5]
        out.append((1 / (1 + np.exp(-x @ model.curve)), spans))
    return out


@pytest.fixture(scope="module")
def sample():
    r, rows, labels = random.Random(3), [], []
    for i in range(240):
        w = [f"é{r.randrange(300)}" if r.random() < 0.2 else f"w{r.randrange(300)}" for _ in range(50)]
        if i % 4 == 0:
            for k in range(3):
                w[(17 * k + i) % 50] = r.choice(["vilea", "vileb", "vilec"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_scores_equal_plain_version(spark, sample):
    rows, labels = sample
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (0, rows[0][1]), (903, "vilea " * 5 + "long words " * 40_000)], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (4, 0), (None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.tag(docs, model).collect()
    assert len(got) == len(rows) + 6
    for row, (score, spans) in zip(got, plain_scores(model, [r["text"] for r in got]), strict=True):
        assert abs(row["score"] - score) < 1e-6 and [(s["start"], s["end"]) for s in row["toxic_spans"]] == spans
    assert {r["score"] for r in got if r["text"] == rows[0][1]} == {got[0]["score"]}


def test_training_rows_are_bounded_and_held_out(spark, sample):
    rows, labels = sample
    docs = spark.createDataFrame([*rows, (1000, "big " * 20_000)], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (1000, 1), (4, 0), (8, 0)], "doc_id long, toxic int")
    picked, counts = toxicity.training_rows(docs, table, max_bytes=6000)
    assert 0 < sum(len(t.encode()) for t in picked["text"].to_pylist()) <= 6000
    every, _ = toxicity.training_rows(docs, table)
    ids = every["doc_id"].to_pylist()
    learned = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    assert set(ids) == learned and dict(zip(ids, every["y"].to_pylist(), strict=True)) == {i: y for i, y in labels if i in learned}
    assert sum(counts.values()) == len(learned) + (zlib.crc32(b"1000") % 5 > 0)
    none, _ = toxicity.training_rows(docs.limit(0), table)
    assert none.num_rows == 0 and toxicity.tag(docs.limit(0), toxicity.train(docs.limit(0), table)).count() == 0


def test_extra_columns(spark, sample):
    docs = spark.createDataFrame([(i, t, 0.25, "x", 7) for i, t in sample[0][:8]], "doc_id long, text string, Score double, y string, turn int")
    got = toxicity.tag(docs, toxicity.Model().fit(pa.chunked_array([["a b", "vile"]]), np.array([0, 1]), {0: 1, 1: 1}))
    assert got.columns == ["doc_id", "text", "y", "turn", "score", "toxic_spans"] and {(r["y"], r["turn"]) for r in got.collect()} == {("x", 7)}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_held_out_accuracy(spark):
    got = toxicity.op9_toxicity(spark, SMALL).where("held_out").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    row = got.agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")).first()
    assert row["n"] > 50 and row["right"] >= 0.95 * row["n"]
