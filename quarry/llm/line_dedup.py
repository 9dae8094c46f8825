"""Line dedup: lines that many documents share stay only in the first of them.

Lines are exploded, normalised and hashed (128 bits); per hash the distinct documents
are counted with map-side partial aggregates, so a line that a third of all documents
hold costs one row per task. Only hashes over the threshold are written out. The lines
meet them in a sort-merge join whose two sides read shuffles directly, so adaptive
execution splits a hot hash over many tasks. Documents are rebuilt by position from the
slices between dropped lines, in time linear in the document. No Python runs.

Defined cases: a null or empty text is one empty line; very long texts are split and
rebuilt like others; a row with a null ``doc_id`` counts for no line and loses none; rows
that repeat a ``doc_id`` are one document, and each row is rebuilt by itself; of documents
that share a line the smallest id keeps it, so there are no ties; an empty table gives no
rows; further columns pass, whatever their names, but ``n_lines`` and ``n_dropped`` in any
case are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._native import finished, inner_names, lower_ascii, strip_blanks
from quarry.session import cut

#: A key has at least this many code points, and counts as shared from this many documents on.
MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    return lower_ascii(strip_blanks(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """All keyed lines (``doc_id, row, pos, hash``) and the shared hashes (``hash, keeper``)."""
    keyed = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    if min_docs <= 2:  # two distinct documents: the smallest is not the largest
        counted = keyed.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        shared = counted.where(F.col("last") > F.col("keeper")) if min_docs == 2 else counted
    else:
        counted = keyed.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.countDistinct("doc_id").alias("n"))
        shared = counted.where(F.col("n") >= min_docs)
    return keyed, cut(shared.select("hash", "keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` rebuilt, and ``n_lines`` (before) and ``n_dropped``."""
    names = inner_names(docs.columns, "doc_id", "text")
    inner = docs.toDF(*names)
    keyed, shared = shared_lines(inner, min_chars, min_docs)
    dropped = (
        keyed.join(shared, "hash")
        .where(F.col("doc_id") > F.col("keeper"))
        .groupBy(F.col("doc_id").alias("drop_doc"), F.col("row").alias("drop_row"))
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))  # at most one document's lines
    )
    joined = inner.join(dropped, (F.col("doc_id") == F.col("drop_doc")) & (F.xxhash64("text") == F.col("drop_row")), "left")
    joined = joined.withColumn("lines", _lines(F.col("text"))).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    at, lines = F.col("gone"), F.col("lines")
    edges = F.zip_with(
        F.concat(F.array(F.lit(-1)), at),
        F.concat(at, F.array(F.size(lines))),
        lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("size")),
    )
    kept = F.flatten(F.transform(edges, lambda e: F.slice(lines, e["start"], e["size"])))
    text = F.when(F.size(at) == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    made = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.size(at).cast("long")}
    return finished(joined, docs.columns, names, made, text=text)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT a.doc_id, a.pos, a.line, coalesce(a.doc_id > s.keeper, false) AS gone
  FROM keyed a LEFT JOIN shared s ON a.k = s.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
