"""Mixing sources to target weights by capped water-filling.

Sizes (words) are reduced per source before anything moves. The level ``t`` of the water
solves ``sum(min(max_epochs * size, t * weight)) = total`` in closed form over the sources
ordered by ``cap / weight``: the same targets that repeated proportional resharing
reaches. A source is then taken ``floor(target / size)`` times whole, and the rest is
filled with documents in the order of a seeded hash; the last of them gives only its
first words, so a source's taken words equal its rounded target.

The running sum over a source's documents never visits one task: documents fall into
hash ranges, as many as ``RANGE_ROWS`` asks for by the number of rows, range sums give
each range's start, and only ranges are ordered inside. So a source with a third of all
rows is spread over all ranges. Sources may be as many as hosts: their order and the
water level come from prefix sums over range-partitioned rows (:func:`prefix_sums`), not
from one task. Everything is built-in functions.

Defined cases: a null or empty text has size 0 and is taken 0 words; very long texts count
whole; a null source is a source of its own, the last; repeated rows count each; equal
hashes are ordered by ``doc_id`` and size, and rows alike in all three are taken alike or
in either order; a null ``doc_id`` hashes as an empty string; an empty table gives no
rows; a source of size 0 has target 0; other columns pass, whatever their names, but those
named like the added ones in any case are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm._native import finished, inner_names, words
from quarry.session import cut

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Rows of a hash range if one source had them all, and the least number of ranges.
RANGE_ROWS, MIN_RANGES = 5_000, 256


def prefix_sums(rows: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of the column over all earlier rows.

    Rows are range-partitioned by ``order``; a partition is summed by itself, and the
    partitions' totals (a row each) give where it starts."""
    placed = cut(rows.orderBy(*order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(*(F.sum(v).alias(f"all_{k}") for k, v in sums.items()))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut(totals.select(F.col("part").alias("at_part"), *(F.coalesce(F.sum(f"all_{k}").over(earlier), F.lit(0)).alias(f"all_{k}") for k in sums)))
    inner = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(starts, F.col("part") == F.col("at_part"))
    return joined.select(*rows.columns, *((F.coalesce(F.sum(v).over(inner), F.lit(0)) + F.col(f"all_{k}")).alias(k) for k, v in sums.items()))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``; weights repeat in source order."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = prefix_sums(per, [F.col("source").asc_nulls_last()], place=F.lit(1))
    cycle = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    capped = placed.select("source", "source_size", cycle.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    summed = prefix_sums(capped, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], place=F.lit(1), full=F.col("cap"),
        closed=F.col("weight"))
    # One row each, by aggregates without keys.
    whole = summed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    tried = (
        summed.crossJoin(F.broadcast(whole))
        .withColumn("tried", (F.col("total") - F.col("full")).cast("double") / (F.col("weights") - F.col("closed")))
    )
    # The level is that of the first source that it does not fill; all before it are full.
    open_ = tried.where(F.col("tried") * F.col("weight") < F.col("cap")).agg(F.min(F.struct("place", F.col("tried").alias("level"))).alias("first"))
    cap = F.col("cap").cast("double")
    return tried.crossJoin(F.broadcast(open_)).select("source", "source_size", F.coalesce(F.least(cap, F.col("first.level") * F.col("weight")), cap).alias("target"))


def _ordered(rows: DataFrame, seed: str) -> DataFrame:
    ranges = max(MIN_RANGES, -(-rows.count() // RANGE_ROWS))
    hashed = rows.withColumn("mix_hash", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # Ranges of equal width over the first 32 bits, so that they are in the order of the hash.
    spot = F.conv(F.substring("mix_hash", 1, 8), 16, 10).cast("long")
    # Never null, so that windows and joins on it deal rows alike, and rows move once.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return hashed.withColumn("mix_range", F.shiftright(spot * F.lit(ranges).cast("long"), 32)).withColumn("mix_key", key)


def _plan(ordered: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """What each hash range of each source starts at, and what its source takes."""
    ranges = cut(ordered.groupBy("source", "mix_key", "mix_range").agg(F.sum("size").alias("size")))
    quota = cut(source_targets(ranges, weights, max_epochs)).withColumnRenamed("source", "of")
    quota = quota.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    quota = quota.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
    quota = quota.withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size")).drop("quota")
    earlier = W.partitionBy("mix_key").orderBy("mix_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select(F.col("source").alias("at"), F.col("mix_key").alias("at_key"), F.col("mix_range").alias("at_range"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    return cut(starts.join(quota, F.col("at").eqNullSafe(F.col("of"))).drop("of", "at"))


def mix_sizes(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds ``source_size, target, taken`` to rows with ``doc_id, source, size``; other columns pass."""
    names = inner_names(rows.columns, "doc_id", "source", "size")
    ordered = _ordered(rows.toDF(*names), seed)
    plan = _plan(ordered, weights, max_epochs)
    inner = W.partitionBy("mix_key", "mix_range").orderBy("mix_hash", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = ordered.withColumn("mix_inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = placed.join(plan, (F.col("mix_key") == F.col("at_key")) & (F.col("mix_range") == F.col("at_range")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("mix_inside")))
    taken = (F.col("whole") * F.col("size") + part).cast("long")
    return finished(joined, rows.columns, names, {"source_size": F.col("source_size"), "target": F.col("target"), "taken": taken})


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: a row per document and repetition. Adds ``copy`` (from 0) and
    ``copy_words``; a last repetition that is not whole has its first words only, joined
    by one space. Documents that are not taken go."""
    names = inner_names(docs.columns, "doc_id", "source", "text")
    mixed = mix_sizes(with_size(docs.toDF(*names)), weights, max_epochs, seed).where("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    copies = copies.withColumn("copy_words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    some = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("copy_words").cast("int")), " ")
    text = F.when(F.col("copy_words") == F.col("size"), F.col("text")).otherwise(some)
    return finished(copies, docs.columns, names, {"copy": F.col("copy"), "copy_words": F.col("copy_words")}, text=text)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = cut(with_size(docs.select("doc_id", "source", "text")).drop("text"))
    return mix_sizes(sizes).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes GROUP BY source),
tried AS (
  SELECT *, row_number() OVER lv AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (lv ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS tried
  FROM per WINDOW lv AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
level AS (SELECT arg_min(tried, place) AS level FROM tried WHERE tried * weight < cap),
quota AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), level * weight), CAST(cap AS DOUBLE)) AS target,
         CAST(floor(coalesce(least(CAST(cap AS DOUBLE), level * weight), CAST(cap AS DOUBLE)) + 0.5) AS BIGINT) AS quota
  FROM tried, level),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes)
SELECT p.doc_id, p.size, q.source_size, q.target,
       CAST(CASE WHEN q.source_size = 0 THEN 0 ELSE (q.quota // q.source_size) * p.size
            + greatest(0, least(p.size, q.quota - (q.quota // q.source_size) * q.source_size - p.before)) END AS BIGINT) AS taken
FROM placed p JOIN quota q ON p.source IS NOT DISTINCT FROM q.source
"""
