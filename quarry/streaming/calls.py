"""Incremental work as streams: windows over a call log, and indexing of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.chunkers.registry import chunk_files
from quarry.session import cut, scratch
from quarry.sources.store import Store


def windowed_calls(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls per tumbling window and tool, over a batch or a stream with ``ts, event_type, value``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, into the shared folder, and returns the result."""
    spark = stream.sparkSession
    base = scratch(spark, f"stream-{name}")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def index_arrivals(spark: SparkSession, incoming: str, store: Store, project: str, state: str) -> None:
    """Chunks files that have arrived since the last run (rows of file_path, content as
    Parquet) into a project's tables. A file that is there already is replaced, so a batch
    that is tried again, or a file that changed, leaves nothing twice."""
    stream = spark.readStream.schema("file_path string, content string").parquet(incoming)

    def upsert(batch: DataFrame, _: int) -> None:
        arrived = cut(batch.groupBy("file_path").agg(F.max("content").alias("content")).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)))
        chunks, files = store.read(project)
        gone = arrived.select("file_path")
        kept = chunks.join(gone, "file_path", "left_anti").unionByName(chunk_files(arrived))
        store.rewrite(project, kept, files.join(gone, "file_path", "left_anti").unionByName(arrived.select("file_path", "hash")))

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(upsert).start().awaitTermination()
