"""The inverted index: the terms of each chunk, and corpus statistics of a table of chunks.

Chunks have ``chunk_id, file_path, language, start_line, end_line, symbol_name, kind,
signature, doc, content``. A row per chunk holds its terms, so texts are never shuffled
and whatever is summed within a chunk (counts, lengths, scores) is summed where the row
is. Only counts of terms and what is left of vector lengths are dealt by term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import idents
from quarry.functions.tokens import tokens

#: Weight of a field's tokens, and points of a query term that is found in it.
FIELDS = {"symbol_name": 3, "file_path": 2, "signature": 1, "doc": 1, "content": 1}
POINTS = {"symbol_name": 3, "file_path": 1, "signature": 2, "doc": 1, "content": 1}
ENTRIES = "chunk_id string, term array<string>, tf array<long>, points array<int>, dlen long, copies long"
#: Identifiers handled at once, identifiers whose tokens a task remembers, and terms whose weights every task gets.
STEP, KNOWN, FREQUENT = 1_000_000, 300_000, 200_000


def steps(lengths: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``step`` values each; a longer row stands alone."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(at, at[first] + step, "right")) - 1)
        yield first, last
        first = last


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column, and how many each row has."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length`` of each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def count_terms(batch: pa.RecordBatch, memo: dict[str, list[str]]) -> pa.RecordBatch:
    """ENTRIES of chunks with the identifiers of each field."""
    values, rows, weights, points = [], [], [], []
    for k, field in enumerate(FIELDS, 1):
        found, lengths = flat(batch.column(k))
        values.append(found)
        rows.append(np.repeat(np.arange(batch.num_rows), lengths))
        weights.append(np.full(len(found), FIELDS[field], np.int64))
        points.append(np.full(len(found), POINTS[field], np.int32))
    coded = pa.concat_arrays(values).dictionary_encode()
    if len(memo) > KNOWN:
        memo.clear()
    names: dict[str, int] = {}
    codes, sizes = [], []
    for ident in coded.dictionary.to_pylist():
        found = memo.get(ident)
        if found is None:
            found = memo[ident] = tokens(ident)
        sizes.append(len(found))
        for t in found:
            codes.append(names.setdefault(t, len(names)))
    sizes, codes, which = np.array(sizes, np.int64), np.array(codes, np.int64), coded.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[which] if len(which) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    term = codes[expanded(starts[which], lengths)] if len(which) else np.zeros(0, np.int64)
    key = np.repeat(np.concatenate(rows), lengths) * max(1, len(names)) + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.add.reduceat(np.repeat(np.concatenate(weights), lengths)[order], heads) if len(heads) else np.zeros(0, np.int64)
    best = np.maximum.reduceat(np.repeat(np.concatenate(points), lengths)[order], heads) if len(heads) else np.zeros(0, np.int32)
    row, term = np.divmod(key[heads], max(1, len(names)))
    offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
    total = np.concatenate([[0], np.cumsum(tf)])
    terms = pa.array(list(names), pa.string()).take(pa.array(term))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), lists(offsets, terms), lists(offsets, pa.array(tf, pa.int64())), lists(offsets, pa.array(best, pa.int32())),
        pa.array(np.diff(total[offsets]), pa.int64()), pa.array(np.ones(batch.num_rows, np.int64))],
        ["chunk_id", "term", "tf", "points", "dlen", "copies"],
    )


def counted(chunks: DataFrame) -> DataFrame:
    """ENTRIES of each row of ``chunks``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for batch in batches:
            lengths = sum(flat(batch.column(k))[1] for k in range(1, len(FIELDS) + 1))
            for first, last in steps(lengths):
                yield count_terms(batch.slice(first, last - first), memo)

    return chunks.select(F.col("chunk_id").cast("string"), *(idents(F.col(f)).alias(f) for f in FIELDS)).mapInArrow(count, ENTRIES)


def exploded(entries: DataFrame) -> DataFrame:
    """``chunk_id, term, tf, points``: one row per chunk and term."""
    return entries.select("chunk_id", F.inline(F.arrays_zip("term", "tf", "points")))


def merged(entries: DataFrame, keep=lambda df: df) -> DataFrame:
    """``entries`` with a row per chunk: rows that repeat a ``chunk_id`` are one chunk, whose counts are summed."""
    repeated = keep(entries.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("of")))
    if not repeated.limit(1).count():
        return entries
    same = F.col("chunk_id").eqNullSafe(F.col("of"))
    several = keep(entries.join(repeated, same, "left_semi"))
    per = exploded(several).groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"), F.max("points").alias("points"))
    rows = per.groupBy(F.col("chunk_id").alias("of")).agg(F.collect_list(F.struct("term", "tf", "points")).alias("x"))
    whole = several.groupBy("chunk_id").agg(F.sum("dlen").alias("dlen"), F.sum("copies").alias("copies")).join(rows, same, "left")
    x = F.coalesce("x", F.array().cast("array<struct<term:string,tf:bigint,points:int>>"))
    whole = whole.select("chunk_id", x["term"].alias("term"), x["tf"].alias("tf"), x["points"].alias("points"), "dlen", "copies")
    return keep(entries.join(repeated, same, "left_anti").unionByName(whole))


def corpus_stats(entries: DataFrame) -> DataFrame:
    """One row: ``n_chunks, avgdl``; a chunk without tokens counts with length 0."""
    total = entries.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("dlen"), F.lit(0)).alias("total"))
    return total.select("n_chunks", F.when(F.col("n_chunks") > 0, F.col("total") / F.col("n_chunks")).otherwise(F.lit(0.0)).alias("avgdl"))


def idf(n: str = "n_chunks", df: str = "df"):
    return F.log(1 + (F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def term_stats(post: DataFrame, corpus: DataFrame) -> DataFrame:
    """``term, df, idf``. The corpus row is one by construction."""
    return post.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(corpus), F.lit(True)).select("term", "df", idf().alias("idf"))


def weights(post: DataFrame, terms: DataFrame) -> DataFrame:
    """``chunk_id, term, w``: L2-normalised tf-idf."""
    raw = post.join(terms.select("term", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "chunk_id").select("chunk_id", "term", F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(F.lit(0.0)).alias("w"))


def frequent(terms: DataFrame, most: int = FREQUENT) -> tuple[pa.Array, np.ndarray]:
    """The most frequent terms, ``most`` at most, and their idf."""
    grade = F.floor(F.log2("df") * 16)
    grades = terms.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).orderBy(F.desc("grade")).collect()  # a few hundred rows
    least, n = None, 0
    for r in grades:
        n += r["n"]
        if n > most:
            break
        least = r["grade"]
    table = terms.where(grade >= least if least is not None else F.lit(False)).select("term", "idf").toArrow()
    return table["term"].combine_chunks().cast(pa.string()), table["idf"].to_numpy()


def vector_lengths(entries: DataFrame, terms: DataFrame, most: int = FREQUENT) -> DataFrame:
    """``chunk_id, norm``: lengths of the tf-idf vectors. Weights of frequent terms go to
    every task and are summed where a chunk is; only rare terms are dealt by term."""
    sent = entries.sparkSession.sparkContext.broadcast(frequent(terms, most))

    def parted(batches: Iterator[pa.RecordBatch], rare: bool) -> Iterator[pa.RecordBatch]:
        names, idf = sent.value
        for batch in batches:
            values, lengths = flat(batch.column(1))
            at = pc.fill_null(pc.index_in(values, value_set=names), -1).to_numpy(zero_copy_only=False)
            tf, row = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), lengths)
            if rare:
                left = np.flatnonzero(at < 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[left])), values.take(pa.array(left)), pa.array(tf[left], pa.int64())],
                    ["chunk_id", "term", "tf"])
            else:
                known = at >= 0
                sums = np.bincount(row[known], (tf[known] * idf[at[known]]) ** 2, batch.num_rows).astype(float)  # of none it counts whole numbers
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], ["chunk_id", "part"])

    rows = entries.select("chunk_id", "term", "tf")
    near = rows.mapInArrow(lambda batches: parted(batches, False), "chunk_id string, part double")
    far = rows.mapInArrow(lambda batches: parted(batches, True), "chunk_id string, term string, tf long").join(terms.select("term", "idf"), "term")
    far = far.groupBy("chunk_id").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("part"))
    return near.unionByName(far).groupBy("chunk_id").agg(F.sqrt(F.sum("part")).alias("norm"))


@dataclass
class Index:
    """The tables that searches read. ``keep`` writes what several of them derive from."""

    chunks: DataFrame
    entries: DataFrame
    keep: object = lambda df: df

    @property
    def postings(self) -> DataFrame:
        """``chunk_id, term, tf, points``: one row per chunk and term."""
        return exploded(self.entries)

    @property
    def docs(self) -> DataFrame:
        """``chunk_id, dlen`` of chunks that have terms."""
        return self.entries.where("dlen > 0").select("chunk_id", "dlen")

    @cached_property
    def corpus(self) -> DataFrame:
        return self.keep(corpus_stats(self.entries))

    @cached_property
    def terms(self) -> DataFrame:
        return self.keep(term_stats(self.postings, self.corpus))

    def terms_in(self, wanted: DataFrame) -> DataFrame:
        """``term, df, idf`` of the few ``wanted`` terms; of all only if they are known already."""
        wanted = F.broadcast(wanted.select("term").distinct())
        if "terms" in self.__dict__:
            return self.terms.join(wanted, "term", "left_semi")
        return term_stats(self.postings.join(wanted, "term", "left_semi"), self.corpus)

    @cached_property
    def norms(self) -> DataFrame:
        """``chunk_id, norm``: lengths of the tf-idf vectors; only the cosine needs them."""
        return self.keep(vector_lengths(self.entries, self.terms))


def build(chunks: DataFrame, keep=lambda df: df) -> Index:
    """``keep`` may persist or write the entries, which every other table derives from."""
    return Index(chunks, merged(keep(counted(chunks)), keep), keep)
