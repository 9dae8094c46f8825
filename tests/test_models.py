"""Interfaces of models: states, calibration, pooling, remote vectors, and searches that use them."""

import json
import math
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.chunkers.registry import chunk_files
from quarry.operators import index, models, scoring
from quarry.plans import fixtures
from quarry.session import cut

# Workers can't import a test module, so its stubs travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
CHUNK = {"chunk_id": "a.go:1:F", "file_path": "a.go", "symbol_name": "F", "kind": "func", "language": "go", "signature": "func F()", "doc": 'says "hi" <b>', "content": "é" * 2000}


@pytest.fixture(scope="module")
def built(spark):
    return index.build(cut(chunk_files(fixtures.files(spark))), cut)


def asked(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id int, query string")


def test_states():
    state = models.score_state("où", CHUNK)
    assert json.loads(state)["chunk"]["content"] == "é" * 1500 and '"query":"où"' in state and '\\"hi\\" <b>' in state and list(json.loads(state)["chunk"]) == ["file", "symbol", "kind", "language", "signature", "doc", "content"]
    gate = json.loads(models.gate_state("q", [CHUNK | {"doc": "d" * 900}] * 8))
    assert len(gate["results"]) == 5 and len(gate["results"][0]["doc"]) == 300 and len(gate["results"][0]["content"]) == 600


@pytest.mark.parametrize("kind, answers, heat", [("score", 6, 2.0), ("score", 2, 0.5), ("score", 4, 5.0), ("noul", 2, 1.5), ("other", 12, 1.0), ("bad", 2, 1.0)])
def test_temperature(kind, answers, heat):
    assert models.temperature(kind, answers, {"score:6-10": 2.0, "score:2": 0.1, "score:3-5": 9.0}, {"noul": 1.5, "bad": math.inf}) == heat


def test_levels():
    logits = np.array([[0.0, 0, 0, 0, 0, 50], [1, 1, 1, 1, 1, 1]])
    assert np.allclose(models.expected_level(logits), [5, 2.5]) and np.allclose(models.softmax(np.array([0.0, math.log(3)])), [0.25, 0.75])
    assert np.allclose(models.softmax(np.array([0.0, math.log(9)]), 2.0), [0.25, 0.75])


def test_pooling_and_lengths():
    vector = models.mean_pool(np.stack([np.ones((1, 384)), 7 * np.ones((1, 384))], 1).reshape(1, 2, 384), np.array([[1, 0]]))
    assert np.allclose(vector, 1 / math.sqrt(384)) and abs(np.linalg.norm(vector) - 1) < 1e-9
    assert not models.mean_pool(np.ones((1, 2, 4)), np.zeros((1, 2))).any()
    assert [models.pad_length(n) for n in (1, 128, 129, 257, 600)] == [128, 128, 256, 512, 512]
    assert models.clip_bytes("é" * 5000) == "é" * 4096 and models.clip_bytes("aé", 2) == "a" and models.clip_bytes("ab") == "ab"


class Letters:
    """A stub: unit vectors of letter counts."""

    dim = 26

    def embed(self, prefix, texts):
        if any("explode" in t for t in texts):
            raise RuntimeError("no model")
        counts = np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], float).reshape(len(texts), 26) + 1e-3
        return counts / np.linalg.norm(counts, axis=1, keepdims=True)


class Longest:
    def score_batch(self, query, chunks):
        if query == "fail":
            raise RuntimeError("no")
        return [min(5.0, len(c["content"]) / 40) for c in chunks]


def test_scorer_in_a_search(spark, built):
    queries = asked(spark, "open the cart", "fail")
    got = scoring.search(built, queries, "hybrid+rerank", 3, models.scored_by(Longest())).orderBy("query_id", "rank").collect()
    sizes = {r["chunk_id"]: len(r["content"]) for r in built.chunks.collect()}
    first = [min(5.0, sizes[r["chunk_id"]] / 40) / 5 for r in got if r["query_id"] == 0]
    assert first == sorted(first, reverse=True) and [r["score"] for r in got if r["query_id"] == 0] == pytest.approx(first)
    plain = scoring.search(built, queries, "hybrid", 3).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in got if r["query_id"] == 1] == [r["chunk_id"] for r in plain if r["query_id"] == 1]
    assert [r["chunk_id"] for r in scoring.search(built, queries, "hybrid+blend", 3, None).orderBy("query_id", "rank").collect()] == [r["chunk_id"] for r in plain]
    level = models.LogitScorer(lambda states: np.array([[0, 0, 0, 0, 0, 9.0] if "openCart" in s else [9.0, 0, 0, 0, 0, 0] for s in states]))
    assert scoring.search(built, queries, "hybrid+rerank", 1, models.scored_by(level)).where("query_id = 0").first()["chunk_id"].endswith("openCart")


def test_first_working():
    said = []

    def broken():
        raise RuntimeError("no library")

    assert models.first_working(broken, Longest, say=said.append).__class__ is Longest and "no library" in said[0]
    assert models.first_working(broken, say=said.append) is None


def test_dense_channel_and_its_fallback(spark, built):
    passages = built.chunks.withColumn("passage", F.col("content"))
    vectors = cut(models.embed_passages(passages, Letters()).select("chunk_id", "embedding"))
    assert vectors.count() == built.chunks.count()
    queries = asked(spark, "openCart fetch cart", "limit")
    got = scoring.search(built, queries, "vec", 3, vectors=vectors, embedder=Letters()).orderBy("query_id", "rank").collect()
    texts = {r["chunk_id"]: r["content"] for r in built.chunks.collect()}
    known = {i: np.float32(Letters().embed("", [t])[0]).astype(float) for i, t in texts.items()}
    for q, text in ((0, "openCart fetch cart"), (1, "limit")):
        wanted = np.float32(Letters().embed("", [text])[0]).astype(float)
        best = sorted(((round(float(v @ wanted), 9), i) for i, v in known.items()), key=lambda x: (-x[0], x[1]))[:3]
        assert [r["chunk_id"] for r in got if r["query_id"] == q] == [i for _, i in best]
    with pytest.warns(UserWarning, match="tf-idf"):
        fallen = scoring.search(built, asked(spark, "explode cart"), "vec", 3, vectors=vectors, embedder=Letters()).orderBy("rank").collect()
    assert [r["chunk_id"] for r in fallen] == [r["chunk_id"] for r in scoring.search(built, asked(spark, "explode cart"), "vec", 3).orderBy("rank").collect()]


def test_vectors_follow_hashes(spark):
    old = spark.createDataFrame([("a", "h", [1.0]), ("b", "old", [1.0]), ("c", "h", None), ("gone", "h", [1.0])], "chunk_id string, hash string, embedding array<float>")
    chunks = spark.createDataFrame([("a", "h"), ("b", "new"), ("c", "h"), ("d", "h")], "chunk_id string, hash string")
    none = {r["chunk_id"]: r["embedding"] for r in models.refresh_vectors(old, chunks, None, chunks.limit(0)).collect()}
    assert none == {"a": [1.0], "b": None, "c": None, "d": None}
    need = chunks.where("chunk_id <> 'a'").withColumn("passage", F.lit("abc"))
    full = {r["chunk_id"]: r["embedding"] for r in models.refresh_vectors(old, chunks, Letters(), need).collect()}
    assert full["a"] == [1.0] and set(full) == set("abcd") and all(len(full[k]) == 26 for k in "bcd")


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            status = 500 if "bad" in body["texts"] else 200
            dim = 3 if "odd" in body["texts"] else 2
            vectors = [[float(len(t))] * dim for t in body["texts"]][: None if "less" not in body["texts"] else -1]
            out = json.dumps({"vectors": vectors}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", asked
    server.shutdown()
    server.server_close()


def test_remote_embedder(service):
    url, seen = service
    remote = models.RemoteEmbedder(url + "/", 2)
    got = remote.embed(models.PASSAGE, ["x" * (k % 7) for k in range(150)])
    assert got.shape == (150, 2) and got[:, 0].tolist() == [k % 7 for k in range(150)]
    assert sorted(len(b["texts"]) for b in seen) == [22, 64, 64] and {b["prefix"] for b in seen} == {"passage: "}
    assert remote.embed(models.QUERY, []).shape == (0, 2)
    for text, why in (("bad", "HTTP 500"), ("odd", "3"), ("less", "vectors for")):
        with pytest.raises(RuntimeError, match=why):
            remote.embed("", [text, "y"])
    with pytest.raises(RuntimeError, match="no answer"):
        models.RemoteEmbedder("http://127.0.0.1:9", 2, 2).embed("", ["x"])


def test_modes_and_limits(spark, built):
    with pytest.raises(ValueError, match="unknown mode"):
        scoring.search(built, asked(spark, "x"), "none")
    with pytest.raises(ValueError, match="empty"):
        scoring.asked_for("  ")
    for k in (0, -1, 51):
        assert scoring.search(built, asked(spark, "cart limit total"), "fts", k).count() <= 5
