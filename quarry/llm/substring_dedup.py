"""Substring dedup with difference-cover anchors.

A window is 35 consecutive words of a document; it repeats if its word sequence starts
anywhere else too. Anchors are the 15 words from those positions of a document that lie
in a difference cover modulo 21: any two positions have a common distance below 21 after
which both are covered, so two equal windows share an equal anchor inside both. Only
anchors (5 of 21 positions) of all texts are exchanged; those that occur twice mark the
windows around them, and an anchor extends to a window if the fingerprint of all 35 words
occurs twice. Each word under a repeated window goes.

Three steps over the same slices of the table (one shuffle of the texts, which Spark
reuses): anchors, windows around shared anchors, and removal. What slices need to know
of each other goes through :mod:`quarry.llm._exchange`, which bears any skew: no pairs
of occurrences are made, and a passage in a third of all documents is asked once per
slice. Anchors have 64 bits (chance agreements only make more candidates); windows have
96, of two hashes that share nothing down to the letters, so at 100 TB (1.6e13 windows)
two unequal windows agree with probability 0.002.

Defined cases: null or empty text has no words and stays empty; a document under 35 words
has no window; a very long text is one document of its slice; repeated rows repeat each
other's windows, the same ``doc_id`` or not (rows alike in id and text lie in one slice
for each block of a file, and in one if the table isn't read from files);
a null ``doc_id`` is a document like any other; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _exchange as X
from quarry.llm._native import inner_names
from quarry.llm._words import Texts, buffers, rolling, slices, windows

WINDOW, PERIOD = 35, 21
#: A perfect difference set: every distance modulo 21 is a difference of two entries.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1

KEPT = "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>"


class Slice:
    """Word hashes of a slice's texts, parsed in pieces of bounded size."""

    def __init__(self, table: pa.Table, windows: bool = True):
        hashes, second, counts, self.pieces = [], [], [], []
        for low, high, data, offsets in slices(table["text"]):
            parsed = Texts(data, offsets)
            hashes.append(parsed.hashes())
            if windows:
                second.append(parsed.hashes(second=True))
            counts.append(parsed.counts)
            self.pieces.append((low, high, parsed))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.second = np.concatenate(second) if second else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the anchors."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        starts, document = windows(self.first, ANCHOR)
        starts = starts[cover[(starts - self.first[document]) % PERIOD]]
        return rolling(0x9FB21C651E98DF25).runs(self.hashes, starts, starts + ANCHOR), starts

    def near(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (64 and 32 bits) and starts of the windows that hold a marked anchor."""
        starts, _ = windows(self.first, WINDOW)
        seen = np.zeros(len(self.hashes) + 1, np.int64)
        seen[marked + 1] = 1
        seen = np.cumsum(seen)
        starts = starts[seen[starts + PERIOD] > seen[starts]]
        keys = rolling(0xA24BAED4963EE407).runs(self.hashes, starts, starts + WINDOW)
        more = rolling(0xF1357AEA2E62A9C5).runs(self.second, starts, starts + WINDOW)
        return keys, (more >> np.uint64(32)).astype(np.uint32), starts


def ask_anchors(table: pa.Table, buckets: int) -> pa.Table:
    return X.ask(table["slice"][0].as_py(), X.distinct(Slice(table, windows=False).anchors()[0])[0], buckets)


def candidates(part: Slice, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, starts = part.anchors()
    return part.near(starts[X.repeated(keys, None, answers)])


def ask_windows(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not table.num_rows:
        return X.ask(0, np.zeros(0, np.uint64), buckets)
    keys, more, _ = candidates(Slice(table), answers)
    keys, more = X.distinct(keys, more)
    return X.ask(table["slice"][0].as_py(), keys, buckets, more)


def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Answers hold the shared windows of the slice (kind 1) and its shared anchors (kind 0)."""
    part = Slice(table) if table.num_rows else None
    rows: dict[str, list] = {"doc_id": table["doc_id"].to_pylist(), "text": [], "n_words": [], "n_removed": [], "removed": []}
    if part:
        kind = answers["kind"].to_numpy()
        keys, more, starts = candidates(part, answers.filter(pa.array(kind == 0)))
        starts = starts[X.repeated(keys, more, answers.filter(pa.array(kind == 1)))]
        edge = np.zeros(len(part.hashes) + WINDOW + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        kept = np.cumsum(edge)[: len(part.hashes)] == 0
        at = 0
        for low, high, parsed in part.pieces:
            for k in range(high - low):
                n = parsed.first[k + 1] - parsed.first[k]
                own = kept[at : at + n]
                words = parsed.bytes_of(k).split()
                flips = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
                text = words if not len(flips) else [w for w, keep in zip(words, own.tolist(), strict=True) if keep]
                rows["text"].append(b" ".join(text).decode())
                rows["n_words"].append(int(n))
                rows["n_removed"].append(int(n - own.sum()))
                rows["removed"].append([{"start": int(a), "end": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)])
                at += n
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = {"doc_id": pa.int64(), "text": pa.string(), "n_words": pa.int64(), "n_removed": pa.int64(), "removed": span}
    return pa.table({k: pa.array(v, types[k]) for k, v in rows.items()})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (kept words joined by one space), ``n_words``, ``n_removed``
    and ``removed`` (spans of words, ends exclusive) of each row of ``docs``."""
    names = inner_names(docs.columns, "doc_id", "text")
    docs = docs.toDF(*names).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = X.text_size(docs)
    # About a quarter of the words start an anchor, and a word takes six bytes.
    plan = X.Plan.of(docs.sparkSession, size, size // 24)
    dealt, buckets = X.deal(docs, plan, "doc_id", "text"), plan.buckets

    def first(table: pa.Table) -> pa.Table:
        return ask_anchors(table, buckets)

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        return ask_windows(table, answers, buckets)

    anchors = X.shared_keys(X.each_slice(dealt, first, X.ASKED), plan)
    wins = X.shared_keys(X.with_answers(dealt, anchors, plan, second, X.ASKED), plan)
    both = anchors.withColumn("kind", F.lit(0)).unionByName(wins.withColumn("kind", F.lit(1)))
    return X.with_answers(dealt, both, plan, remove, KEPT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
twice AS (SELECT s FROM windows GROUP BY 1 HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM windows JOIN twice USING (s)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words),
-- The last repeated window that starts at or before a word covers it if it is near enough.
marked AS (
  SELECT p.doc_id, p.k, p.word, coalesce(p.k - max(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS UNBOUNDED PRECEDING) < 35, false) AS gone
  FROM placed p LEFT JOIN starts s ON s.doc_id = p.doc_id AND s.i = p.k)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM words d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""
