"""Places for models: scorers of a pool and embedders of texts.

No model comes with this package. A scorer or embedder is any object with the methods
below; it is sent to the executors, which call it on batches.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.index import Index

#: Relevance runs from 0 to TOP.
TOP = 5
# Characters of a chunk's parts that a scorer sees, and chunks that the sufficiency gate sees.
CONTENT_CHARS, GATE_CONTENT_CHARS, GATE_DOC_CHARS, GATE_CHUNKS = 1500, 600, 300, 5
# Bounds of a calibration temperature, and the groups of answer counts that it is kept for.
COLDEST, HOTTEST = 0.5, 5.0
COUNT_GROUPS = ((2, "2"), (5, "3-5"), (10, "6-10"))
# Bytes of a text and tokens that an embedder sees, lengths that batches are padded to, texts of a request, and requests at once.
TEXT_BYTES, PAD_LENGTHS, REQUEST_TEXTS, REQUESTS = 8192, (128, 256, 512), 64, 2
PASSAGE, QUERY = "passage: ", "query: "


class Scorer(Protocol):
    def score_batch(self, query: str, chunks: Sequence[Mapping]) -> Sequence[float]:
        """Relevance (0 to TOP) of each chunk to the query."""


class Embedder(Protocol):
    dim: int

    def embed(self, prefix: str, texts: Sequence[str]) -> np.ndarray:
        """A unit vector per text."""


# Scorers


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def score_state(query: str, chunk: Mapping) -> str:
    """What a model is asked to score."""
    shown = {k: chunk[c] for k, c in (("file", "file_path"), ("symbol", "symbol_name"), ("kind", "kind"), ("language", "language"),
        ("signature", "signature"), ("doc", "doc"))}
    return compact({"query": query, "chunk": shown | {"content": chunk["content"][:CONTENT_CHARS]}})


def gate_state(query: str, chunks: Sequence[Mapping]) -> str:
    """What a model is asked to find sufficient."""
    shown = [{"file": c["file_path"], "symbol": c["symbol_name"], "signature": c["signature"], "doc": c["doc"][:GATE_DOC_CHARS],
        "content": c["content"][:GATE_CONTENT_CHARS]} for c in chunks[:GATE_CHUNKS]]
    return compact({"query": query, "results": shown})


def temperature(kind: str, answers: int, by_count: Mapping[str, float], by_kind: Mapping[str, float]) -> float:
    """The calibration of a kind of question with so many answers, within its bounds; 1 if it is no number."""
    group = next((name for most, name in COUNT_GROUPS if answers <= most), "11+")
    value = by_count.get(f"{kind}:{group}", by_kind.get(kind, float("nan")))
    return float(np.clip(value, COLDEST, HOTTEST)) if np.isfinite(value) else 1.0


def softmax(logits: np.ndarray, heat: float = 1.0) -> np.ndarray:
    z = np.asarray(logits, float) / heat
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def expected_level(logits: np.ndarray, heat: float = 1.0) -> np.ndarray:
    """The mean level, 0 to TOP, under the answers' probabilities."""
    p = softmax(logits, heat)
    return p @ np.arange(p.shape[-1])


class LogitScorer:
    """A scorer over a model that gives a row of logits (one per level) for each state."""

    def __init__(self, model: Callable[[Sequence[str]], np.ndarray], heat: float = 1.0):
        self.model, self.heat = model, heat

    def score_batch(self, query: str, chunks: Sequence[Mapping]) -> Sequence[float]:
        return expected_level(self.model([score_state(query, c) for c in chunks]), self.heat)


def scored_by(scorer: Scorer) -> Callable[[Index, object, DataFrame], DataFrame]:
    """``query_id, chunk_id, relevance`` of the pairs of a pool, for ``scoring.rerank``. A
    query's pool has a fixed number of rows, so it is one batch; a failure scores 0."""

    def scores(index: Index, asked, pairs: DataFrame) -> DataFrame:
        wanted = ("chunk_id", "file_path", "language", "symbol_name", "kind", "signature", "doc", "content")
        kind = pairs.schema["query_id"].dataType.simpleString()
        pool = pairs.select("query_id", "chunk_id").join(asked.queries.select("query_id", "query"), "query_id").join(index.chunks.select(*wanted), "chunk_id")

        def one(batch: pd.DataFrame) -> pd.DataFrame:
            try:
                found = [float(x) for x in scorer.score_batch(batch["query"].iloc[0], batch[list(wanted)].to_dict("records"))]
            except Exception as error:  # noqa: BLE001  a model that fails doesn't end a search
                warnings.warn(f"scorer failed: {error}", stacklevel=1)
                found = [0.0] * len(batch)
            return pd.DataFrame({"query_id": batch["query_id"], "chunk_id": batch["chunk_id"], "relevance": found})

        return pool.groupBy("query_id").applyInPandas(one, f"query_id {kind}, chunk_id string, relevance double")

    return scores


def first_working(*factories: Callable[[], object], say: Callable[[str], None] = warnings.warn):
    """What the first factory makes that doesn't fail; None if all do."""
    for make in factories:
        try:
            return make()
        except Exception as error:  # noqa: BLE001  the next one is the fallback
            say(f"{getattr(make, '__name__', make)}: {error}")
    return None


# Embedders


def clip_bytes(text: str, limit: int = TEXT_BYTES) -> str:
    """At most so many bytes of a text, whole characters only."""
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit].decode(errors="ignore")


def pad_length(tokens: int) -> int:
    return next((n for n in PAD_LENGTHS if tokens <= n), PAD_LENGTHS[-1])


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit mean of the rows (texts, tokens, dim) that the mask keeps; zeros where it keeps none."""
    weight = np.asarray(mask, float)[..., None]
    mean = (np.asarray(hidden, float) * weight).sum(-2) / np.maximum(weight.sum(-2), 1)
    return mean / np.maximum(np.linalg.norm(mean, axis=-1, keepdims=True), np.finfo(float).tiny)


class RemoteEmbedder:
    """Vectors from a service: POST ``/embed`` with texts and a prefix answers their vectors."""

    def __init__(self, url: str, dim: int, timeout: float = 120.0):
        self.url, self.dim, self.timeout = url.rstrip("/"), dim, timeout

    def _ask(self, prefix: str, texts: Sequence[str]) -> np.ndarray:
        request = urllib.request.Request(f"{self.url}/embed", json.dumps({"texts": list(texts), "prefix": prefix}).encode(), {"Content-Type": "application/json"})
        for attempt in (0, 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    vectors = json.load(answer)["vectors"]
                break
            except urllib.error.HTTPError as error:
                raise RuntimeError(f"{self.url}: HTTP {error.code}: {error.read().decode(errors='replace').strip()}") from None
            except urllib.error.URLError as error:
                # The service may just be starting: one more try where nobody listens.
                if attempt or not isinstance(error.reason, ConnectionRefusedError):
                    raise RuntimeError(f"no answer from {self.url}: {error.reason}") from None
        if len(vectors) != len(texts):
            raise RuntimeError(f"{self.url}: {len(vectors)} vectors for {len(texts)} texts")
        if any(len(v) != self.dim for v in vectors):
            raise RuntimeError(f"{self.url}: vectors of {sorted({len(v) for v in vectors})} numbers, not {self.dim}")
        return np.array(vectors, float).reshape(len(texts), self.dim)

    def embed(self, prefix: str, texts: Sequence[str]) -> np.ndarray:
        parts = [texts[k : k + REQUEST_TEXTS] for k in range(0, len(texts), REQUEST_TEXTS)]
        with ThreadPoolExecutor(REQUESTS) as pool:
            return np.concatenate([np.zeros((0, self.dim)), *pool.map(lambda p: self._ask(prefix, p), parts)])


def embed_passages(passages: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunk_id, hash, embedding`` of rows with a ``passage``; batches keep the order of the rows."""

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder.embed(PASSAGE, [clip_bytes(t) for t in batch["passage"]])
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "hash": batch["hash"], "embedding": [[float(x) for x in v] for v in vectors]})

    return passages.select("chunk_id", "hash", "passage").mapInPandas(embedded, "chunk_id string, hash string, embedding array<float>")


def refresh_vectors(vectors: DataFrame, chunks: DataFrame, embedder: Embedder | None, need: DataFrame) -> DataFrame:
    """``chunk_id, hash, embedding`` of all chunks: kept where the hash is the same, made
    anew for ``need``, null where a changed chunk meets no embedder."""
    kept = vectors.where("embedding IS NOT NULL").join(chunks.select("chunk_id", "hash"), ["chunk_id", "hash"], "left_semi").select("chunk_id", "hash", "embedding")
    if embedder is None:
        rest = chunks.join(kept, "chunk_id", "left_anti").select("chunk_id", "hash", F.lit(None).cast("array<float>").alias("embedding"))
        return kept.unionByName(rest)
    return kept.join(need.select("chunk_id"), "chunk_id", "left_anti").unionByName(embed_passages(need, embedder))


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """``query_id, query_vec``; queries are a stated set, embedded on the executors."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder.embed(QUERY, [clip_bytes(t) for t in batch["query"]])
            yield pd.DataFrame({"query_id": batch["query_id"], "query_vec": [[float(x) for x in v] for v in vectors]})

    return queries.select("query_id", "query").mapInPandas(embedded, f"query_id {kind}, query_vec array<float>")
