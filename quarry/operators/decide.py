"""Cut-off, sufficiency and response payloads over ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR, GAP = 0.5, 0.05
ENOUGH = 0.5


def filter_relevant(hits: DataFrame) -> DataFrame:
    """The first hit of each query, and others above both the floor and the first less the gap."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return hits.withColumn("top", top).where((F.col("rank") == 1) | (F.col("score") > F.greatest(F.lit(FLOOR), F.col("top") - GAP))).drop("top")


def noul(hits: DataFrame) -> DataFrame:
    """``query_id, noul, need_more`` from the five best: their level and the first one's lead."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    rest = F.coalesce(F.avg(F.when(F.col("rank").between(2, 5), F.col("score"))), F.lit(0.0))
    z = 1.6 * F.col("s1") + 1.2 * (F.col("s1") - F.col("rest")) - 1.5
    found = hits.groupBy("query_id").agg(first.alias("s1"), rest.alias("rest")).select("query_id", (1 / (1 + F.exp(-z))).alias("noul"))
    return found.withColumn("need_more", F.col("noul") < ENOUGH)


def payload(hits: DataFrame, kept: DataFrame, gate: DataFrame, k: int) -> DataFrame:
    """``query_id, n_hits, more_available, noul, need_more``."""
    raw = hits.groupBy("query_id").agg(F.count("*").alias("n_raw"))
    n = kept.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    return raw.join(n, "query_id").join(gate, "query_id").select("query_id", "n_hits",
        ((F.col("n_raw") == k) | (F.col("n_hits") < F.col("n_raw"))).alias("more_available"), "noul", "need_more")
