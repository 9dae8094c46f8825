"""Nearest unit vectors: exact in blocks, and approximate by inverted lists.

Exact search multiplies blocks of a stated query set with Arrow batches of the vectors;
each batch keeps the best k per query, and a window over these few rows ranks them. The
index puts every vector into the list of its nearest centre; centres are fitted on a
bounded sample (``SAMPLE`` rows), and a query looks into the lists of its nearest centres
only. Lists are cut into parts, so a list with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import cut

#: Queries of a block, rows that centres are fitted on, vectors of a part of a list.
BLOCK, SAMPLE, PART = 4096, 20_000, 20_000
ROUNDS, SEED, TARGET = 12, 7, 0.95


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_of(ids: pa.Array, vectors: np.ndarray, names: pa.Array, queries: np.ndarray, k: int) -> pa.Table:
    """The k best rows of a batch for each query, with their scores; more where the last ones tie."""
    scores = queries @ vectors.T
    if len(ids) > k:
        # Ranks are by scores to nine places, so what ties with the k-th stays too.
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(scores >= least[:, None] - 1e-9)
    else:
        row, col = np.divmod(np.arange(scores.size), max(1, len(ids)))
    return pa.table({"query_id": names.take(pa.array(row)), "chunk_id": ids.take(pa.array(col)), "score": pa.array(scores[row, col], pa.float64())})


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _schema(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the nearest of ``vectors`` (``vec_id,
    embedding``; null embeddings are left out) for each of ``queries`` (``query_id,
    query_vec``). A pass over the vectors per block of queries."""
    known, schema, found = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding"), _schema(vectors, queries), None
    asked = cut(queries.where("query_vec IS NOT NULL").select("query_id", "query_vec"))
    blocks = max(1, -(-asked.count() // block))
    for b in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # about BLOCK rows
        sent = known.sparkSession.sparkContext.broadcast((table["query_id"].combine_chunks(), matrix(table["query_vec"])))

        def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, wanted = sent.value
            for batch in batches:
                if batch.num_rows and len(names):
                    yield from best_of(batch.column(0), matrix(batch.column(1)), names, wanted, k).to_batches()

        part = known.mapInArrow(scored, schema)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k)


def sample_of(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """At most ``sample`` rows, in the order of a hash of their id."""
    rows = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    return matrix(rows["embedding"])


def fit_centres(points: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres by spherical k-means."""
    centres = points[np.random.default_rng(SEED).permutation(len(points))[:lists]]
    for _ in range(ROUNDS if len(points) else 0):
        near = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        some = np.linalg.norm(sums, axis=1) > 0
        centres[some] = sums[some] / np.linalg.norm(sums[some], axis=1, keepdims=True)
    return centres


def needed_probes(points: np.ndarray, centres: np.ndarray, k: int, target: float, asked: int = 256) -> int:
    """Lists to look into so that the share ``target`` of the k nearest is found, measured
    on the sample: its neighbours are further apart than those of the whole table, so the
    table needs no more."""
    if not len(points):
        return 1
    some = points[:asked]
    near = (points @ centres.T).argmax(1)
    order = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)
    wanted = np.argsort(-(some @ points.T), axis=1)[:, :k]
    places = np.sort(np.take_along_axis(order, near[wanted], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1


class Lists:
    """An approximate index: every row of ``vectors`` in one list. ``probes`` is how many
    lists a search looks into, from what ``target`` recall of ``k`` needs."""

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, k: int = 10, target: float = TARGET):
        known = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
        points = sample_of(known, sample)
        self.centres = fit_centres(points, lists or max(1, min(sample // 8, int(known.count() ** 0.5))))
        self.probes = needed_probes(points, self.centres, k, target)
        kind = vectors.schema["vec_id"].dataType.simpleString()
        sent = vectors.sparkSession.sparkContext.broadcast(self.centres)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = (matrix(batch.column(1)) @ sent.value.T).argmax(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["vec_id", "embedding", "list"])

        rows = cut(known.mapInArrow(placed, f"vec_id {kind}, embedding array<float>, list int"))
        sizes = cut(rows.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
        self.parts = sizes
        self.rows = cut(rows.join(sizes, "list").select("vec_id", "embedding", "list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``query_id, chunk_id, score, rank`` from the ``probes`` lists nearest to each query."""
        sent, probes = queries.sparkSession.sparkContext.broadcast(self.centres), min(probes or self.probes, len(self.centres))
        kind = queries.schema["query_id"].dataType.simpleString()

        def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and probes:
                    near = np.argsort(-(matrix(batch.column(1)) @ sent.value.T), axis=1, kind="stable")[:, :probes]
                    where = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where),
                        pa.array(near.ravel().astype(np.int32))], ["query_id", "query_vec", "list"])

        asked = queries.where("query_vec IS NOT NULL").select("query_id", "query_vec").mapInArrow(aimed, f"query_id {kind}, query_vec array<float>, list int")
        asked = asked.join(self.parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            if not mine.num_rows or not theirs.num_rows:
                return pa.table({"query_id": theirs["query_id"].slice(0, 0), "chunk_id": mine["vec_id"].slice(0, 0), "score": pa.array([], pa.float64())})
            ids, vectors = mine["vec_id"].combine_chunks(), matrix(mine["embedding"])
            blocks = (theirs.slice(a, BLOCK) for a in range(0, theirs.num_rows, BLOCK))
            return pa.concat_tables(best_of(ids, vectors, q["query_id"].combine_chunks(), matrix(q["query_vec"]), k) for q in blocks)

        pairs = self.rows.groupBy("list", "part").cogroup(asked.groupBy("list", "part"))
        return ranked(pairs.applyInArrow(scored, _schema(self.rows, queries)), k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: the share of the exact hits that the approximate ones have."""
    hit = wanted.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
