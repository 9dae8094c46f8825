"""The driver's tables as the engine's inputs: documents as one-chunk files, benchmark items as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import lines_of
from quarry.operators.index import Index, build
from quarry.session import cut


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    # Every second file counts as Python, whose comments begin with another mark.
    language = F.when(F.col("doc_id") % 2 == 0, "python").otherwise("text")
    return docs.select("doc_id", "source", "lang", path.alias("file_path"), language.alias("language"), F.coalesce("text", F.lit("")).alias("content"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a title, and short lines as headings of the depth of their first letter's number."""
    docs = files(spark, sf_dir)
    lines = F.transform(lines_of(F.col("content")), lambda x: F.when(F.length(x).between(1, 60),
        F.concat(F.repeat(F.lit("#"), F.length(x) % 7), F.lit(" "), x)).otherwise(x))
    return docs.select("file_path", F.concat(F.lit("# "), F.col("file_path"), F.lit("\n"), F.array_join(lines, "\n")).alias("content"))


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as settings: every short line names a section."""
    docs = files(spark, sf_dir)
    lines = F.transform(lines_of(F.col("content")), lambda x: F.when(F.length(x).between(1, 60),
        F.concat(F.lit("["), F.translate(x, "[]", "()"), F.lit("]"))).otherwise(x))
    return docs.select("file_path", F.array_join(lines, "\n").alias("content"))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python: a function per line, with the line as its docstring."""
    docs = files(spark, sf_dir)
    bare = lambda x: F.translate(x, "\\\"'", "")
    lines = F.transform(lines_of(F.col("content")), lambda x, i: F.concat(F.lit("def line_"), (i + 1).cast("string"), F.lit('():\n    """'), bare(x),
        F.lit('"""\n')))
    return docs.select(F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.array_join(lines, "\n").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return files(spark, sf_dir).select(
        F.concat("file_path", F.lit(":1:"), name).alias("chunk_id"),
        "doc_id",
        "source",
        "lang",
        "file_path",
        F.lit("text").alias("language"),
        F.lit(1).alias("start_line"),
        F.size(lines_of(F.col("content"))).alias("end_line"),
        name.alias("symbol_name"),
        F.lit("file").alias("kind"),
        name.alias("signature"),
        F.lit("").alias("doc"),
        "content",
    )


def index(spark: SparkSession, sf_dir: str) -> Index:
    return build(chunks(spark, sf_dir), keep=cut)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and the messages of conversations as queries with names."""
    items = queries(spark, sf_dir).select(F.concat(F.lit("item:"), F.col("query_id").cast("string")).alias("query_id"), "query")
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = F.concat_ws(":", F.lit("talk"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return items.unionByName(talks.select(name.alias("query_id"), F.coalesce("text", F.lit("")).alias("query")))


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text word for word; the items are a stated query set.

    A text that holds an item has each inner word of it between the same blanks, so items
    meet texts by their longest inner word and are then tested; the few items without one
    are tested on every text."""
    docs = chunks(spark, sf_dir).select("doc_id", "chunk_id", "lang", "content")
    words = lambda text: F.split(text, r"[\x20\x09-\x0D]+", -1)
    inner = lambda text: F.slice(words(text), F.lit(2), F.greatest(F.size(words(text)) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner(F.col("query")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = queries(spark, sf_dir).withColumn("key", longest)
    # The items go to where the texts are, so texts are not shuffled.
    spoken = docs.select("chunk_id", "lang", "content", F.explode(F.array_distinct(words(F.col("content")))).alias("key"))
    found = spoken.join(F.broadcast(items.where("key <> ''")), "key").where(F.contains("content", "query"))
    short = docs.join(F.broadcast(items.where("key IS NULL OR key = ''").select("query_id", "query")), F.contains("content", "query"))
    return found.select("query_id", "chunk_id", "lang").unionByName(short.select("query_id", "chunk_id", "lang")).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "ts", F.col("event_type").alias("tool"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("response_bytes"))
