"""Which fingerprints occur in more than one slice of a table, exactly and evenly.

A table is dealt into many slices. Each slice asks about its distinct fingerprints, packed
per bucket of the fingerprint's value; a bucket answers each slice with those that another
slice has too. A fingerprint that a third of all rows hold is asked once per slice, so no
bucket depends on how often it occurs, and no pairs are made.

Slices and buckets are counted from the size of the data (:class:`Plan`), so either side
of the exchange fits a task, and both grow with it up to a bound, so that a packet (the
keys of one slice for one bucket) holds ``PACKET`` keys for as long as memory allows: to
about 2 TB of text; at 100 TB it holds two or three, and a key takes about 12 bytes in the
shuffle instead of 8. Shuffles have as many partitions as their bytes ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a slice, and fingerprints in a bucket: at first, and at most; the least number of either.
SLICE, MOST_SLICE, BUCKET, MOST_BUCKET, LEAST = 4 << 20, 32 << 20, 500_000, 8_000_000, 512
#: Keys that a packet should hold, and slices that a task should read.
PACKET, SLICES = 32, 2

ASKED = "bucket int, slice int, keys binary, more binary"
ANSWERED = "slice int, keys binary, more binary"


@dataclass(frozen=True)
class Plan:
    """Numbers of slices, of buckets, and of the partitions that either are shuffled to."""

    slices: int
    buckets: int
    slice_parts: int
    bucket_parts: int

    @classmethod
    def of(cls, spark: SparkSession, text_bytes: int, keys: int) -> Plan:
        part, bucket = SLICE, BUCKET
        count = lambda total, each: max(LEAST, -(-total // each))
        while count(text_bytes, part) * count(keys, bucket) * PACKET > keys and (part < MOST_SLICE or bucket < MOST_BUCKET):
            part, bucket = min(MOST_SLICE, 2 * part), min(MOST_BUCKET, 2 * bucket)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        slices, buckets = count(text_bytes, part), count(keys, bucket)
        return cls(slices, buckets, min(slices, max(least, -(-text_bytes // (SLICES * part)))), min(buckets, max(least, -(-keys // bucket))))


def packed(table: dict[str, np.ndarray], owner: np.ndarray, keys: np.ndarray, more: np.ndarray | None) -> pa.Table:
    """A row per run of equal owners, with the columns of ``table`` there and the packed keys."""
    edges = np.flatnonzero(np.diff(owner)) + 1
    heads = np.concatenate([[0], edges]) if len(owner) else np.zeros(0, np.int64)
    parts = lambda x: pa.array([p.tobytes() for p in np.split(x, edges)] if len(owner) else [], pa.binary())
    columns = {k: pa.array(v[heads].astype(np.int32), pa.int32()) for k, v in table.items()}
    return pa.table(columns | {"keys": parts(keys), "more": pa.nulls(len(heads), pa.binary()) if more is None else parts(more)})


def ask(slice_id: int, keys: np.ndarray, buckets: int, more: np.ndarray | None = None) -> pa.Table:
    """Distinct keys of a slice, packed per bucket: 64 bits, and 32 further ones in ``more``."""
    bucket = (keys >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    return packed({"bucket": bucket, "slice": np.full(len(keys), slice_id)}, bucket, keys[order], None if more is None else more[order])


def columns_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """All keys of packed rows, their further bits if any, and the row that each is from."""
    parts = [np.frombuffer(k.as_buffer(), np.uint64) for k in table["keys"]]
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    more = None
    if parts and table["more"].null_count == 0:
        more = np.concatenate([np.frombuffer(k.as_buffer(), np.uint32) for k in table["more"]])
    return keys, more, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def in_order(keys: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and whether each in it equals the one before."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    if more is not None:
        same[1:] &= more[order][1:] == more[order][:-1]
    return order, same


def _answer(table: pa.Table) -> pa.Table:
    ids = table["slice"].to_numpy()
    keys, more, owner = columns_of(table)
    order, same = in_order(keys, more)
    shared = order[same | np.append(same[1:], False)]
    shared = shared[np.argsort(owner[shared], kind="stable")]
    return packed({"slice": ids[owner[shared]]}, owner[shared], keys[shared], None if more is None else more[shared])


def shared_keys(asked: DataFrame, plan: Plan) -> DataFrame:
    """``slice, keys, more`` for the keys of each slice that another slice asked about too."""
    return asked.repartition(plan.bucket_parts, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWERED)


def member(keys: np.ndarray, more: np.ndarray | None, elsewhere: pa.Table) -> np.ndarray:
    """Which keys are among a slice's answers."""
    known, further, _ = columns_of(elsewhere)
    found = np.zeros(len(keys), bool)
    if not len(known):
        return found
    order, _ = in_order(known, further)
    known = known[order]
    at = np.searchsorted(known, keys)
    going = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == keys))
    if more is None:
        found[going] = True
        return found
    further = further[order]
    at = at[going]
    while len(going):  # keys that agree in 64 bits only are next to each other
        found[going[further[at] == more[going]]] = True
        at += 1
        left = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == keys[going]) & ~found[going]
        going, at = going[left], at[left]
    return found


def repeated(keys: np.ndarray, more: np.ndarray | None, elsewhere: pa.Table) -> np.ndarray:
    """Which keys occur twice here, or in another slice."""
    order, same = in_order(keys, more)
    twice = np.zeros(len(keys), bool)
    twice[order] = same | np.append(same[1:], False)[: len(same)]
    return twice | member(keys, more, elsewhere)


def distinct(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    order, same = in_order(keys, more)
    first = order[~same]
    return keys[first], None if more is None else more[first]


def deal(docs: DataFrame, plan: Plan, *by: str) -> DataFrame:
    """``docs`` with a ``slice``. Rows alike in all of ``by`` are told apart by the block of
    the file that they are read from, so that any number of them is dealt to many slices;
    where a row is read from does not change when a lost task runs again."""
    place = F.xxhash64(*by, F.input_file_name(), F.input_file_block_start())
    return docs.withColumn("slice", F.pmod(place, F.lit(plan.slices)).cast("int")).repartition(plan.slice_parts, "slice")


def text_size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def each_slice(dealt: DataFrame, work: Callable[[pa.Table], Iterator[pa.Table] | pa.Table], schema: str) -> DataFrame:
    return dealt.groupBy("slice").applyInArrow(work, schema)


def with_answers(dealt: DataFrame, answers: DataFrame, plan: Plan, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return dealt.groupBy("slice").cogroup(answers.repartition(plan.slice_parts, "slice").groupBy("slice")).applyInArrow(work, schema)
