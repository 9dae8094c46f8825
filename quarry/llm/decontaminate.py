"""Benchmark decontamination by spaced seeds.

A seed takes five of the words under a mask and ignores the rest, so a substituted word
spoils only the seeds that select it. Seeds of the benchmark's items form a sorted index;
every position of every document is hashed under every mask and looked up (a bitmap
first). A hit fixes a diagonal: document position less item position. Around the hits,
item and document are compared word for word on these diagonals (diagonals close to each
other count together, which forgives small insertions), and an item has leaked if at
least 80% of its words are matched. It has also leaked if one run on a diagonal, with at
most ``MAX_GAP`` words changed in a row, matches ``RUN_WORDS`` words, or if the runs of
all diagonals together match 80% in the item's order, however much stands between them.
Items of fewer than ``MIN_ITEM_WORDS`` words are looked up whole and word for word.
Words are lower-cased runs of letters and digits.

A place of a document is looked up in all items at once, and of hits that follow each
other on a diagonal only the first counts, in batches of ``HITS``. A first comparison of
whole diagonals, in batches too, leaves the pairs of document and item that can be leaks;
only these are looked at one by one. So an opening that thousands of items share costs
no row per hit, and memory is bounded however often a text repeats it.

Items are taken in blocks of at most ``MAX_INDEX_WORDS`` words (bounded by their bytes),
one pass over the documents for each. A pass holds one block's index, which a Python
worker builds once; between passes the table is written. One block or many, the code and
the result are the same, and no pass shuffles documents. An item is never cut, so a
single item beyond the bound makes a block of its own size.

Defined cases: null or empty texts leak nothing, and neither do texts of very many words
alone; items without words, or null ones, are no evidence and never match; repeated items
report each id once, with their greatest overlap; repeated documents are judged alike;
an empty table of documents gives no rows and an empty benchmark no leaks; other columns
pass, whatever their names, but a column named ``leaks`` in any case is replaced.
"""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._native import finished, inner_names
from quarry.llm._words import SEPARATES, Texts, buffers, mix, slices, stream, windows
from quarry.session import cut

#: Positions that each mask selects.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 4, 6, 7))
MIN_ITEM_WORDS, MIN_OVERLAP, NEAR_DIAGONALS = 8, 0.8, 8
#: Matched words of a run that are a leak whatever the item's length, and words in a row that a run may miss.
RUN_WORDS, MAX_GAP = 16, 2
MAX_INDEX_WORDS = 4_000_000
BITMAP_BITS = 24
#: Hits that are held at once, and words that are compared at once.
HITS, COMPARED = 1 << 20, 1 << 21


def seeds(hashes: np.ndarray, first: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, start and document of every place where a mask fits."""
    offsets = MASKS[mask]
    starts, document = windows(first, offsets[-1] + 1)
    odd = stream(0xC0FFEE + mask, len(offsets)) | np.uint64(1)
    total = np.zeros(len(starts), np.uint64)
    for k, o in enumerate(offsets):
        total += hashes[starts + o] * odd[k]
    return mix(total), starts, document


def exact(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, start and document of every run of ``length`` words."""
    starts, document = windows(first, length)
    odd = stream(0xE8AC7 + length, length) | np.uint64(1)
    total = np.zeros(len(starts), np.uint64)
    for k in range(length):
        total += hashes[starts + k] * odd[k]
    return mix(total), starts, document


def leaked(wanted: np.ndarray, own: np.ndarray, shifts: np.ndarray) -> float:
    """Share of an item's words found in a document on the given ascending diagonals, 0 if that is no leak."""
    size, step = len(wanted), max(1, COMPARED // max(1, len(wanted)))
    cluster = np.concatenate([[0], np.cumsum(np.diff(shifts) > NEAR_DIAGONALS)])
    best, longest, covered, places = 0, 0, np.zeros(size, bool), []
    union, of = np.zeros(size, bool), -1
    for low in range(0, len(shifts), step):
        rows = shifts[low : low + step, None]
        at = rows + np.arange(size)
        same = (at >= 0) & (at < len(own))
        same &= own[np.clip(at, 0, len(own) - 1)] == wanted
        # Diagonals close to each other count together; the last group may go on in the next step.
        groups = cluster[low : low + step]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1])
        unions = np.logical_or.reduceat(same, edges, axis=0)
        if groups[0] == of:
            unions[0] |= union
        best, union, of = max(best, int(unions.sum(1).max()), int(union.sum())), unions[-1], groups[-1]
        row, word = np.nonzero(same)
        begins = np.concatenate([[True], (np.diff(row) > 0) | (np.diff(word) > MAX_GAP + 1)]) if len(row) else np.zeros(0, bool)
        run = np.cumsum(begins) - 1
        matched = np.bincount(run, minlength=1)
        longest = max(longest, int(matched.max()))
        part = matched[run] >= len(MASKS[0])
        covered[word[part]] = True
        places.append(np.stack([word[part], (word + rows[row, 0])[part]], 1))
    if best >= MIN_OVERLAP * size:
        return best / size
    if longest >= RUN_WORDS:
        return max(best, int(covered.sum())) / size
    if covered.sum() < MIN_OVERLAP * size:
        return 0.0
    # The most words of the item that the document holds in the item's order, over all diagonals.
    pairs = np.concatenate(places)
    ends: list[int] = []
    for place in pairs[np.lexsort((-pairs[:, 1], pairs[:, 0])), 1].tolist():
        k = bisect_left(ends, place)
        ends[k : k + 1] = [place]
    return max(best, len(ends)) / size if len(ends) >= MIN_OVERLAP * size else 0.0


def batches_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to about ``limit``."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, "right")))
        yield low, high
        low = high


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 3: owners 0 0 1 1 1 and places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted distinct rows of a matrix of three columns."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], np.any(rows[1:] != rows[:-1], axis=1)])] if len(rows) else rows


class Index:
    """Seeds of a block of items."""

    def __init__(self, ids: np.ndarray, texts: pa.Array | pa.ChunkedArray):
        parsed = Texts(*buffers(texts), SEPARATES)
        self.hashes, self.first, self.ids = parsed.hashes(lower=True), parsed.first, ids
        enough = parsed.counts >= MIN_ITEM_WORDS
        keys, items, places, before = [], [], [], []
        for mask in range(len(MASKS)):
            key, start, item = seeds(self.hashes, self.first, mask)
            last = np.where(np.diff(item, prepend=-1) == 0, np.roll(key, 1), np.uint64(0))
            keep = enough[item]
            keys.append(key[keep])
            items.append(item[keep].astype(np.int32))
            places.append((start - self.first[item])[keep].astype(np.int32))
            before.append(last[keep])
        keys, items, places, before = map(np.concatenate, (keys, items, places, before))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(1, MIN_ITEM_WORDS):
            key, _, item = exact(self.hashes, self.first, length)
            own = parsed.counts[item] == length
            order = np.argsort(key[own], kind="stable")
            if len(order):
                self.short[length] = key[own][order], item[own][order]
        order = np.argsort(keys, kind="stable")
        #: Seeds in order, their items and places there, and the seed one word earlier under the same mask (0 if none).
        self.keys, self.items, self.places, self.before = keys[order], items[order], places[order], before[order]
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[self.keys >> np.uint64(64 - BITMAP_BITS)] = True

    def diagonals(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item, diagonal) of all hits."""
        found = [np.zeros((0, 3), np.int64)]
        for mask in range(len(MASKS)):
            key, start, document = seeds(hashes, first, mask)
            at = np.flatnonzero(self.bitmap[key >> np.uint64(64 - BITMAP_BITS)])
            low, high = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            before = np.where((at > 0) & (document[at] == document[at - 1]), key[at - 1], np.uint64(0))
            place = start[at] - first[document[at]]
            for a, b in batches_of(high - low, HITS):
                hit, entry = spread(high[a:b] - low[a:b])
                entry += low[a:b][hit]
                # On a diagonal where the last place hit too, this hit says nothing new.
                head = (before[a:b][hit] == 0) | (self.before[entry] != before[a:b][hit])
                hit, entry = hit[head], entry[head]
                found.append(distinct(np.stack([document[at[a:b]][hit], self.items[entry].astype(np.int64), place[a:b][hit] - self.places[entry]], 1)))
        return distinct(np.concatenate(found))

    def likely(self, lines: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Those of the ``lines`` by document and item that can be leaks: enough words match on one diagonal or on all together."""
        document, item, shift = lines.T
        sizes, lengths = np.diff(self.first)[item], np.diff(first)[document]
        begin, end = np.maximum(0, -shift), np.minimum(sizes, lengths - shift)
        matched = np.zeros(len(lines), np.int64)
        for a, b in batches_of(end - begin, COMPARED):
            owner, at = spread(end[a:b] - begin[a:b])
            owner += a
            at += begin[owner]
            same = self.hashes[self.first[item[owner]] + at] == hashes[first[document[owner]] + at + shift[owner]]
            matched[a:b] = np.bincount(owner - a, same, b - a)
        starts = np.concatenate([[0], np.flatnonzero(np.any(lines[1:, :2] != lines[:-1, :2], axis=1)) + 1])
        some = (np.maximum.reduceat(matched, starts) >= RUN_WORDS) | (np.add.reduceat(matched, starts) >= MIN_OVERLAP * sizes[starts])
        ends = np.append(starts[1:], len(lines))
        return [lines[a:b] for a, b in zip(starts[some], ends[some], strict=True)]

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """Per document of a slice, the items that leaked into it and their overlaps."""
        parsed = Texts(data, offsets, SEPARATES)
        hashes = parsed.hashes(lower=True)
        out: dict[int, list[tuple[int, float]]] = {}
        lines = self.diagonals(hashes, parsed.first)
        for group in self.likely(lines, hashes, parsed.first) if len(lines) else []:
            document, item = int(group[0, 0]), int(group[0, 1])
            wanted = self.hashes[self.first[item] : self.first[item + 1]]
            own = hashes[parsed.first[document] : parsed.first[document + 1]]
            if overlap := leaked(wanted, own, group[:, 2]):
                out.setdefault(document, []).append((int(self.ids[item]), overlap))
        for document, item in self.short_hits(hashes, parsed.first):
            out.setdefault(document, []).append((int(self.ids[item]), 1.0))
        return out

    def short_hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Documents and the items of fewer than ``MIN_ITEM_WORDS`` words that they hold word for word."""
        for length, (keys, items) in self.short.items():
            key, _, document = exact(hashes, first, length)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at = np.flatnonzero(high > low)
            pairs = np.unique(np.stack([document[at], low[at], high[at]], 1), axis=0)
            yield from ((int(d), int(items[k])) for d, a, b in pairs for k in range(a, b))


LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("overlap", T.DoubleType())]))
ARROW_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64())]))


#: The index that this Python worker has built last.
_BUILT: dict[str, Index] = {}


def _built(token: str, sent: bytes) -> Index:
    if token not in _BUILT:
        _BUILT.clear()
        ids, texts = pickle.loads(sent)
        _BUILT[token] = Index(ids, pa.array(texts, pa.string()))
    return _BUILT[token]


def _pass(docs: DataFrame, items: DataFrame):
    """``docs`` with the leaks of a block of ``items`` added to their ``leaks``, and the broadcast that it uses."""
    table = items.toArrow()
    token, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(pickle.dumps((table["item_id"].to_numpy(), table["text"].to_pylist())))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _built(token, sent.value)
        for batch in batches:
            names = batch.schema.names
            leaks = batch.column(names.index("leaks")).to_pylist()
            for low, _, data, offsets in slices(batch.column(names.index("text"))):
                for k, found in index.leaks(data, offsets).items():
                    best = {x["item_id"]: x["overlap"] for x in leaks[low + k]}
                    for item, overlap in found:
                        best[item] = max(overlap, best.get(item, 0.0))
                    leaks[low + k] = [{"item_id": i, "overlap": o} for i, o in sorted(best.items())]
            columns = [pa.array(leaks, ARROW_LEAK) if n == "leaks" else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(checked, docs.schema), sent


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, overlap), ascending by id."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    # Every word takes a byte and a separator at least, so this bounds the index from above.
    size = items.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2))).first()[0] or 0
    blocks = max(1, -(-int(size) // max_words))
    names = inner_names(docs.columns, "text")
    found = docs.toDF(*names).withColumn("leaks", F.array().cast(LEAK))
    for k in range(blocks):
        found, sent = _pass(found, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k))
        if k < blocks - 1:
            found = cut(found)
            sent.unpersist()
    return finished(found, docs.columns, names, {"leaks": F.col("leaks")})


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak."""
    names = inner_names(docs.columns, "text")
    found = find_leaks(docs.toDF(*names), benchmark).where(F.size("leaks") == 0)
    return finished(found, docs.columns, names)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("leaked"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["overlap"])), F.lit(0.0)).alias("overlap"),
    )
