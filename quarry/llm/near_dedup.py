"""Near-dedup by SuperMinHash, banding, verification and union-find grouping.

1. One pass over the texts gives each document the size and fingerprint of its shingle
   set and the keys of its signature's bands (26 bands of 5 rows: two sets of similarity
   0.85 fail to meet in any band with probability 3e-7).
2. Documents of equal sets are one class (partial aggregate), so copies never multiply.
3. Classes that share a band key are candidates. In every key, all its classes are
   compared with one central class (the one that meets most others), on full sets.
   Components follow by min-label propagation with pointer jumping.
4. Keys that still hold more than one component are finished: each class outside the
   key's largest component is compared with the key's classes of other components. Large
   keys are cut into blocks by rows and by shingles, so a task's share is bounded; pairs
   are compared inside tasks, only between sets of sizes that can be similar, and only
   links leave them (a union-find drops those that join nothing). A key that would take
   more than ``HOT_PAIRS`` comparisons is cut into sub-keys by a second band first, which
   joins nearly all that is alike in it; then, under the labels that this gives, the key
   itself is finished like the others, whatever that takes.

So classes that share a key are in one component, or have been compared: no link between
candidates is lost, and none is made without a full comparison. All joins are on keys that partial aggregates or blocks have thinned,
or are sort-merge joins of written tables, which adaptive execution splits.

Defined cases: null or empty text has an empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle; very long texts are compared on their full
sets; rows that repeat a ``doc_id`` are judged by their own texts (rows alike stand or
fall together; unlike ones whose classes share the smallest id count as linked); a null
``doc_id`` is never the smallest, and a class of such rows alone has no id and keeps its
rows; of a component the smallest id stays, so there are no ties; an empty table gives no
rows; other columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._minhash import band_keys, set_key, shingle_sets, super_minhash
from quarry.llm._native import finished, inner_names
from quarry.llm._words import slices
from quarry.session import cut, drop

BANDS, ROWS = 26, 5
#: What the operator takes by itself: shingles of five words, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Classes of a key that are compared in one block, their shingles, and the rounds after which label propagation must have ended.
BLOCK, WEIGHT, MAX_ROUNDS = 128, 100_000, 64
#: Comparisons from which a key is cut by a second band before it is finished.
HOT_PAIRS = 4_000_000

SKETCH = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, bands = [], [], []
            for _, _, data, offsets in slices(batch.column(2)):
                sets = shingle_sets(data, offsets, shingle)
                counts += [len(s) for s in sets]
                keys += [set_key(s) for s in sets]
                bands += list(band_keys(super_minhash(sets, BANDS * ROWS), BANDS, ROWS).view(np.int64))
            bands = [b if n else None for b, n in zip(bands, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([a for a, _ in keys], pa.int64()),
                pa.array([b for _, b in keys], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sketched, SKETCH)


class Links:
    """Compares sets inside a task and keeps the links that join something new."""

    def __init__(self, percent: int):
        self.percent, self.up = percent, {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def compare(table: pa.Table, shingle: int, percent: int) -> pa.Table:
    """Links among the classes of a unit. Rows with a text bring it; rows with a key say
    which classes are compared: in each key, pivots with all others of another label."""
    texts = table.filter(pc.is_valid(table["text"]))
    member = table.filter(pc.is_null(table["text"]))
    ids = texts["id"].to_numpy()
    sets: list[np.ndarray] = []
    for _, _, data, offsets in slices(texts["text"]):
        sets += shingle_sets(data, offsets, shingle)
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, coded = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = {int(i): k for k, i in enumerate(ids)}
    keys, who, labels, pivots = (member[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "label", "pivot"))
    order = np.argsort(keys, kind="stable")
    links, union, mark = [], Links(percent), np.zeros(len(vocabulary), bool)
    for group in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(order) else []:
        at = np.array([place[int(i)] for i in who[group]])
        by_size = np.lexsort((who[group], sizes[at]))
        at, group = at[by_size], group[by_size]
        size = sizes[at]
        pool = np.concatenate([coded[first[k] : first[k + 1]] for k in at])
        starts = np.concatenate([[0], np.cumsum(size)])
        for k, row in zip(at, group, strict=True):
            if not pivots[row]:
                continue
            # Only sets of sizes that can be similar enough.
            low, high = np.searchsorted(size, -(-percent * sizes[k] // 100), "left"), np.searchsorted(size, 100 * sizes[k] // percent, "right")
            mine = coded[first[k] : first[k + 1]]
            mark[mine] = True
            common = np.add.reduceat(mark[pool[starts[low] : starts[high]]].astype(np.int64), starts[low:high] - starts[low])
            mark[mine] = False
            rows = group[low:high]
            near = (100 * common >= percent * (size[low:high] + sizes[k] - common)) & (labels[rows] != labels[row])
            for other, label in zip(who[rows][near].tolist(), labels[rows][near].tolist(), strict=True):
                if union.join(int(labels[row]), label):
                    links.append((int(who[row]), other))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def verified(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``a, b`` among ``members`` (unit, key, id, label, pivot), whose ``texts`` are (id, text)."""
    members = cut(members)
    brought = members.select("unit", "id").distinct().join(texts, "id").select("unit", F.lit(None).cast("long").alias("key"), "id",
        F.lit(None).cast("long").alias("label"), F.lit(None).cast("boolean").alias("pivot"), "text")
    rows = members.select("unit", "key", "id", "label", "pivot", F.lit(None).cast("string").alias("text")).unionByName(brought)

    def work(table: pa.Table) -> pa.Table:
        return compare(table, shingle, percent)

    return rows.groupBy("unit").applyInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, label``: for every linked id the smallest id that it reaches."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = before = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("label")))
    for _ in range(MAX_ROUNDS):
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = cut(labels.join(around, "id").select("id", "label", F.least("label", "near").alias("new")))
        jump = lower.select(F.col("id").alias("new"), F.col("new").alias("further"))
        moved = cut(lower.join(jump, "new").select("id", F.col("further").alias("to"), "label"))
        drop(before, lower)
        labels, before = moved.select("id", F.col("to").alias("label")), moved
        if not moved.where("to < label").limit(1).count():
            drop(edges)
            return labels
    raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")


def _candidates(classes: DataFrame) -> DataFrame:
    """``id, size, key, n``: classes (``size`` shingles) in keys that several classes share."""
    keyed = classes.select("id", "size", F.explode("bands").alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return cut(keyed.join(sizes, "key").select("id", "size", "key", "n"))


def _blocks(rows: Column, shingles: Column, more: int = 1) -> Column:
    """Blocks into which so many classes with so many shingles are cut."""
    return F.greatest(F.ceil(rows / (more * BLOCK)), F.ceil(shingles / (more * WEIGHT)), F.lit(1)).cast("int")


def _around_leaders(shared: DataFrame) -> DataFrame:
    """Units in which each key's classes meet its central class."""
    central = shared.groupBy("id").agg(F.sum("n").alias("meets"))
    leaders = shared.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("leader"))
    pairs = cut(shared.join(cut(leaders), "key").where("id != leader").select("leader", "id", "size").distinct())
    # Written, so that both sides of the join are shuffles, which adaptive execution splits at a hot leader.
    sizes = cut(pairs.groupBy(F.col("leader").alias("of")).agg(_blocks(F.count("*"), F.sum("size"), 2).alias("blocks")))
    placed = cut(pairs.join(sizes, F.col("leader") == F.col("of")).select("leader", "id",
        F.xxhash64("leader", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("unit")))
    others = placed.select("unit", F.col("leader").alias("key"), "id", F.col("id").alias("label"), F.lit(False).alias("pivot"))
    heads = placed.select("unit", F.col("leader").alias("key")).distinct().select("unit", "key", F.col("key").alias("id"), F.col("key").alias("label"),
        F.lit(True).alias("pivot"))
    return others.unionByName(heads)


def _several(known: DataFrame) -> DataFrame:
    """What is left to compare in each key with several components: its rows and shingles, and those outside its largest component."""
    per = known.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"))
    main = F.max(F.struct("n", -F.col("label"), "w"))
    keys = per.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("rows"), F.sum("w").alias("weight"), F.sum("s").alias("same"),
        main.alias("main"), F.min("label").alias("least")).where("labels > 1")
    return keys.select("key", "rows", "weight", "same", "least", (-F.col("main.col2")).alias("main"), (F.col("rows") - F.col("main.n")).alias("out"),
        (F.col("weight") - F.col("main.w")).alias("out_weight"))


def _split_hot(known: DataFrame, hot: DataFrame) -> DataFrame:
    """``known`` with sub-keys of two bands in place of the ``hot`` keys."""
    inside = known.join(hot, "key", "left_semi")
    second = known.select("id", F.col("key").alias("second"))
    both = inside.join(second, "id").where("key != second")
    sub = both.select("id", "size", "label", F.xxhash64(F.least("key", "second"), F.greatest("key", "second")).alias("key")).distinct()
    return cut(known.join(hot, "key", "left_anti").unionByName(sub.select(*known.columns)))


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return cut(shared.join(labels, "id", "left").select("key", "id", "size", F.coalesce("label", "id").alias("label")))


def _left_over(shared: DataFrame, labels: DataFrame, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame | None]:
    """Units for keys that hold several components still; and the keys that only their sub-keys stand for there, if there are any."""
    known = _labelled(shared, labels)
    hot = cut(_several(known).where(F.col("out") * F.col("rows") > hot_pairs).select("key"))
    if not hot.limit(1).count():
        return _units(known), None
    return _units(_split_hot(known, hot)), hot


def _units(known: DataFrame) -> DataFrame:
    """Units that finish the keys of ``known``."""
    # Keys with the same classes (several bands agree on a group) are finished once.
    keys = cut(_several(known).groupBy("rows", "weight", "same", "main", "out", "out_weight", "least").agg(F.min("key").alias("key")))
    # Small keys of a component share a unit, for they share texts too.
    whole = cut(keys.groupBy(F.col("least").alias("of")).agg(_blocks(F.sum("rows"), F.sum("weight"), 2).alias("parts")))
    group = F.xxhash64("least", F.pmod(F.xxhash64("key"), F.col("parts")))
    keys = cut(keys.join(whole, F.col("least") == F.col("of")).select("key", "main", group.alias("group"),
        _blocks(F.col("out"), F.col("out_weight")).alias("n_i"), _blocks(F.col("rows"), F.col("weight"), 2).alias("n_j")))
    placed = known.join(keys, "key").withColumn("pivot", F.col("label") != F.col("main"))
    spot = lambda c: F.pmod(F.xxhash64("id", "key"), F.col(c)).cast("int")
    placed = placed.withColumn("own_i", F.pmod(F.xxhash64("key", "id"), F.col("n_i")).cast("int")).withColumn("own_j", spot("n_j"))
    # A class meets the pivots of every block i in its own block j; a pivot of block i meets every other block j too.
    meets = lambda i, j, pivot: F.struct(i.alias("i"), j.alias("j"), pivot.alias("pivot"))
    across = F.transform(F.sequence(F.lit(0), F.col("n_i") - 1), lambda i: meets(i, F.col("own_j"), F.col("pivot") & (i == F.col("own_i"))))
    down = F.transform(F.filter(F.sequence(F.lit(0), F.col("n_j") - 1), lambda j: F.col("pivot") & (j != F.col("own_j"))),
        lambda j: meets(F.col("own_i"), j, F.lit(True)))
    met = placed.select("group", "key", "id", "label", "n_i", "n_j", F.inline(F.concat(across, down)))
    key = F.xxhash64("key", "i", "j")
    small = (F.col("n_i") == 1) & (F.col("n_j") == 1)
    return met.select(F.when(small, F.xxhash64("group", F.lit(0))).otherwise(key).alias("unit"), key.alias("key"), "id", "label", "pivot")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for each row of ``docs``."""
    rows = cut(sketch(docs, shingle))
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.min_by("text_hash", "doc_id").alias("of_text"),
        F.first("bands").alias("bands"), F.first("n_shingles").alias("size")))
    shared = _candidates(classes)
    wanted = shared.select("id").distinct().join(classes.select("id", "of_text"), "id")
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("of_text"), "text")
    texts = cut(source.join(wanted, ["id", "of_text"]).dropDuplicates(["id"]).select("id", "text"))
    links = cut(verified(_around_leaders(shared), texts, shingle, percent))
    labels = components(links)
    units, hot = _left_over(shared, labels)
    rest = cut(verified(units, texts, shingle, percent))
    if rest.limit(1).count():
        links = links.unionByName(rest)
        labels = components(links)
    if hot is not None:
        # What shares a hot key and no other one has met in no sub-key.
        last = cut(verified(_units(_labelled(shared.join(hot, "key", "left_semi"), labels)), texts, shingle, percent))
        if last.limit(1).count():
            labels = components(links.unionByName(last))
    named = cut(classes.join(labels, "id", "left").select("set_a", "set_b", F.coalesce("label", "id").alias("component")))
    drop(classes, shared, texts, links, rest)
    # Empty sets are all alike, and never linked: they stay out of the join.
    found = rows.where("n_shingles > 0").join(named, ["set_a", "set_b"], "left").select("doc_id", "text_hash", "n_shingles", "component")
    found = found.unionByName(rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component")))
    component = F.col("component")
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull()).alias("kept"))


def dedup_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component."""
    names = inner_names(docs.columns, "doc_id", "text")
    inner = docs.toDF(*names)
    kept = near_duplicates(inner, shingle, percent).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    found = inner.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash")), "left_semi")
    return finished(found, docs.columns, names)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
