"""From raw documents to a training mix: five stages, each over all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``; the last returns the mix, a row per document and repetition.

Every stage takes only the columns of ``documents`` (of several that differ by case the
first), so further columns, whatever their names, are left out; an empty table gives an
empty one with the same columns. Rows with a null ``doc_id`` are documents like any other
except where a stage says so, and texts are always taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from quarry.llm._native import inner_names
from quarry.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mix draws on a per-row hash order and signatures, which SQL can't express.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.toDF(*inner_names(docs.columns, *COLUMNS)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or diverge from their language go.

    Null, empty and blank texts fail the counts; very long ones are measured whole; a null
    or rare ``lang`` has no reference, and only the counts judge; repeated rows stand or
    fall together; a distance that equals its threshold stays."""
    return _columns(quality.quality_rules(_columns(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in the first document only; ``n_chars`` follows the text.

    A null text becomes an empty one; a row with a null ``doc_id`` loses no line and makes
    none go; of documents that share a line the smallest id keeps it (rows that repeat an
    id are one document, so both keep it); very long texts are rebuilt line by line."""
    return _columns(line_dedup.dedup_lines(_columns(docs)).withColumn("n_chars", F.length("text").cast("long")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, 0.8).

    It is the one with the smallest id; rows that repeat it stay with it. Null and empty
    texts are like nothing and stay; rows with a null ``doc_id`` go if their text is in
    another document's group, and stay otherwise; very long texts are compared on all
    their shingles."""
    return _columns(near_dedup.dedup_documents(_columns(docs)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold none; null and empty items are held by none; repeated rows
    stand or fall together; an empty benchmark lets all stay."""
    return _columns(decontaminate.decontaminate(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole and fractional repetitions by source weights, with ``copy`` and ``copy_words``.

    Texts without words are never taken; a null source is a source of its own, the last;
    repeated rows count each; equal hashes (a null id hashes as an empty string) are
    ordered by id and size."""
    return mixing.mix_documents(_columns(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
