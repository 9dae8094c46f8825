"""Toxicity: a linear-chain conditional random field over words.

Only whole documents carry labels, so training labels words first: a word is toxic in a
toxic document if one of its features (the word or a prefix of it) is many times as
frequent in toxic as in other training documents. The field learns these spans from at
most ``MAX_TOXIC + MAX_OTHER`` labelled documents, in the order of a hash of their id, and
of these from no more than ``MAX_BYTES`` of text: both are documented bounds, so what
comes to the driver has a fixed size, and training goes through it in chunks. A labelled
text of more than ``MAX_TEXT`` bytes is never a training row (it is scored like others).
Forward-backward marginals of every word of every document then give the expected number
of toxic words, the surest word, the rate and the offsets of toxic words; a logistic curve
over the numbers, fitted on the same training rows and weighted back to their true
proportions, turns them into a score. Scoring is one pass over the whole texts, without a
shuffle; the model travels as a broadcast of fixed size.

Defined cases: a null or empty text scores as one without toxic words; labels that are
null or stand on no document are ignored; a document whose labels differ is toxic; several
rows of one labelled id train each; without labelled rows of both kinds the score is the
labels' mean (0 without labels); repeated rows score alike; a score of exactly 0.5 is
predicted toxic; an empty table gives no rows; other columns pass, but those named
``score`` or ``toxic_spans`` in any case are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._crf import BITS, CHUNK, Field, tokens
from quarry.llm._native import finished, inner_names
from quarry.llm._words import Texts, buffers, slices
from quarry.session import cut

#: Labelled documents the model may see, of each kind; bytes of one of their texts, and of all.
MAX_TOXIC, MAX_OTHER = 800, 1600
MAX_TEXT, MAX_BYTES = 1 << 15, 8 << 20
#: A feature marks toxic words if it is in this many toxic training documents, this many times as often as in others.
MIN_TOXIC_DOCS, MIN_RATIO = 4, 12.0
FOLDS = 5


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, held_out: int = 0, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER,
    max_text: int = MAX_TEXT, max_bytes: int = MAX_BYTES) -> tuple[pa.Table, dict[int, int]]:
    """A bounded sample of labelled texts outside the held-out fold, and the label counts."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != held_out)).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    known = cut(known.select("id", "y", F.xxhash64("id").alias("turn")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = known.where("y = 1").orderBy("turn", "id").limit(max_toxic).unionByName(known.where("y = 0").orderBy("turn", "id").limit(max_other))
    # At most max_toxic + max_other ids by construction, so this side may be broadcast.
    rows = docs.where(F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= max_text)).select("doc_id",
        "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # Rows of repeated ids may be many; the running sum is over numbers, in the order of the hash, and texts come only for those within it.
    sized = cut(rows.select("doc_id", "text", "y", "turn", size.alias("bytes")).orderBy("turn", "doc_id", "text").limit(max_toxic + max_other))
    running = W.orderBy("turn", "doc_id", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = sized.withColumn("upto", F.sum("bytes").over(running)).where(F.col("upto") <= max_bytes)
    return within.select("doc_id", "text", "y").toArrow().sort_by("doc_id"), counts


class Model:
    def __init__(self, prior: float = 0.0):
        self.field, self.curve, self.prior = None, None, prior

    def fit(self, texts: pa.ChunkedArray, y: np.ndarray, counts: dict[int, int]) -> Model:
        total = counts.get(0, 0) + counts.get(1, 0)
        self.prior = counts.get(1, 0) / total if total else 0.0
        if len(y) == 0 or y.min() == y.max():
            return self
        parsed, features = tokens(*buffers(texts))
        document = np.repeat(np.arange(len(parsed)), parsed.counts)
        toxic = y == 1
        size = 1 << BITS
        # Documents that have a feature.
        inside, outside = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k in range(len(parsed)):
            has = np.unique(features[parsed.first[k] : parsed.first[k + 1]])
            (inside if toxic[k] else outside)[has] += 1
        rate = ((inside + 0.1) / (toxic.sum() + 1)) / ((outside + 0.1) / ((~toxic).sum() + 1))
        marks = (inside >= MIN_TOXIC_DOCS) & (rate >= MIN_RATIO)
        words = marks[features].any(1) & toxic[document]
        starts = parsed.first[:-1][parsed.counts > 0]
        self.field = Field().fit(features, starts, words)
        x = self.summary(np.concatenate([self.field.marginals(features[a:b], own) for a, b, own in self.parts(parsed)]), parsed.first)
        share = {k: counts.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
        self.curve = logistic(x, y, np.where(toxic, share[1], share[0]))
        return self

    @staticmethod
    def parts(parsed: Texts) -> Iterator[tuple[int, int, np.ndarray]]:
        """Ranges of words of whole documents, about CHUNK words each, and where their documents begin in them."""
        low = 0
        while low < len(parsed):
            high = max(low + 1, int(np.searchsorted(parsed.first, parsed.first[low] + CHUNK, "right")) - 1)
            own = parsed.first[low : high + 1] - parsed.first[low]
            yield int(parsed.first[low]), int(parsed.first[high]), own[:-1][np.diff(own) > 0]
            low = high

    @staticmethod
    def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(first)
        total, most = np.zeros(len(counts)), np.zeros(len(counts))
        some = counts > 0
        if some.any():
            total[some] = np.add.reduceat(p, first[:-1][some])
            most[some] = np.maximum.reduceat(p, first[:-1][some])
        return np.stack([np.log1p(total), most, np.log1p(100 * total / np.maximum(counts, 1)), np.log1p(counts)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray, cut: float = 0.5):
        """Document scores, and the byte spans of toxic words as (document, start, end)."""
        n = len(offsets) - 1
        if self.field is None:
            return np.full(n, self.prior), np.zeros((0, 3), np.int64)
        parsed, features = tokens(data, offsets)
        p = self.field.marginals(features, parsed.first[:-1][parsed.counts > 0])
        at = np.flatnonzero(p >= cut)
        spans = np.stack([np.searchsorted(parsed.first, at, "right") - 1, parsed.starts[at], parsed.ends[at]], 1)
        x = np.concatenate([self.summary(p, parsed.first), np.ones((n, 1))], 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30))), spans


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(curvature, slope)
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows, counts = training_rows(docs, labels)
    return Model().fit(rows["text"], rows["y"].to_numpy(), counts)


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``toxic_spans`` (code points, ends exclusive)."""
    names = inner_names(docs.columns, "text")
    inner = docs.toDF(*names)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", span)])
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(sent.value)
        for batch in batches:
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for low, high, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                scores[low:high], found = fitted.score(data, offsets)
                heads = (data & 0xC0) != 0x80  # code points begin here
                for k in np.unique(found[:, 0]):
                    begin, mine = offsets[k], found[found[:, 0] == k]
                    points = np.concatenate([[0], np.cumsum(heads[begin : offsets[k + 1]])])
                    spans[low + k] = [{"start": int(points[s - begin]), "end": int(points[e - begin])} for _, s, e in mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(spans, SPAN)], [*batch.schema.names, "score", "toxic_spans"])

    return finished(inner.mapInArrow(tagged, schema), docs.columns, names, {"score": F.col("score"), "toxic_spans": F.col("toxic_spans")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    tagged = tag(docs, train(docs, labels))
    return tagged.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_spans").cast("long").alias("n_spans"), "toxic_spans")
