"""Symbol lookup, references, spans, manifests and incremental updates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import lines_of, strip_code

MAX_REFERENCES = 50


def find_symbol(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.where(F.lower("symbol_name") == name.lower()).select("file_path", "start_line", "end_line", "symbol_name", "kind", "language", "signature")


def word_pattern(name: str) -> str:
    """A whole-word pattern: ASCII edges for ASCII names, Unicode edges otherwise."""
    edge = "[A-Za-z0-9_]" if re.fullmatch(r"[A-Za-z0-9_].*[A-Za-z0-9_]|[A-Za-z0-9_]", name, re.S) else r"[\p{L}\p{Nd}_]"
    quoted = re.sub(r"([^A-Za-z0-9_\u0080-\U0010FFFF])", r"\\\1", name)
    return f"(?<!{edge}){quoted}(?!{edge})"


def all_references(files: DataFrame, name: str) -> DataFrame:
    """``file_path, line, text`` of every line that names a symbol outside literals and comments."""
    lines = files.select("file_path", "language", F.posexplode(lines_of(F.col("content"))).alias("pos", "text"))
    bare = strip_code(F.col("text"), F.col("language"))
    return lines.where(F.contains("text", F.lit(name)) & bare.rlike(word_pattern(name))).select("file_path", (F.col("pos") + 1).alias("line"),
        F.trim("text").alias("text"))


def find_references(files: DataFrame, name: str, limit: int = MAX_REFERENCES) -> DataFrame:
    """The first references by file and line; ``truncated`` says whether there are more."""
    found = all_references(files, name).orderBy("file_path", "line").limit(limit + 1)
    place = W.orderBy("file_path", "line")  # limit + 1 rows at most
    return found.select("*", F.row_number().over(place).alias("place"),
        (F.count("*").over(W.partitionBy()) > limit).alias("truncated")).where(F.col("place") <= limit).drop("place")


def read_span(files: DataFrame, first: Column, last: Column) -> DataFrame:
    """``file_path, span``: lines first to last (from 1, inclusive), clamped to the file; null if none is left."""
    lines = files.withColumn("_lines", lines_of(F.col("content")))
    a, b = F.greatest(first, F.lit(1)), F.least(last, F.size("_lines"))
    return lines.select("file_path", F.when(a <= b, F.array_join(F.slice("_lines", a, b - a + 1), "\n")).alias("span"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def plan_update(now: DataFrame, before: DataFrame) -> DataFrame:
    """``file_path, action``: keep, reindex or remove, from two manifests."""
    b = before.select(F.col("file_path").alias("old_path"), F.col("hash").alias("old_hash"))
    both = now.join(b, F.col("file_path") == F.col("old_path"), "full")
    action = F.when(F.col("file_path").isNull(), "remove").when(F.col("hash").eqNullSafe(F.col("old_hash")), "keep").otherwise("reindex")
    return both.select(F.coalesce("file_path", "old_path").alias("file_path"), action.alias("action"))


def removed(now: DataFrame, before: DataFrame) -> DataFrame:
    return before.join(now, "file_path", "left_anti")


def upsert(current: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``current`` with rows of ``changed`` in place of or beside its own, and without ``gone`` keys."""
    kept = current.join(changed.select(key), key, "left_anti").unionByName(changed)
    return kept.join(gone.select(key), key, "left_anti")


def need_embedding(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks that are new, changed, or have no vector yet."""
    e = existing.select(F.col("chunk_id").alias("_id"), F.col("hash").alias("_hash"), F.col("has_vector").alias("_has"))
    joined = chunks.join(e, F.col("chunk_id") == F.col("_id"), "left")
    return joined.where(F.col("_id").isNull() | ~F.col("hash").eqNullSafe(F.col("_hash")) | ~F.coalesce("_has", F.lit(False))).select(*chunks.columns)


def resolve_projects(projects: DataFrame, asked: DataFrame, default: str = "") -> DataFrame:
    """``asked, name, path``: the project (``name, path, pos``) that each name of ``asked``
    stands for: exact, then any case, then path; blank means the default, else the first.
    Names that no project has are left out."""
    wanted = asked.select("asked", F.when(F.trim("asked") == "", F.lit(default)).otherwise(F.trim("asked")).alias("wanted"))
    names = projects.select("name", "path", "pos")
    ways = ((F.col("wanted") == F.col("name"), 0), (F.lower("wanted") == F.lower("name"), 1), (F.rtrim("wanted", F.lit("/")) == F.rtrim("path", F.lit("/")), 2))
    found = [wanted.join(names, on).select("asked", F.lit(prio).alias("prio"), "pos", "name", "path") for on, prio in ways]
    first = names.orderBy("pos").limit(1)
    found.append(wanted.where(F.trim("asked") == "").join(F.broadcast(first), F.lit(True)).select("asked", F.lit(3).alias("prio"), "pos", "name", "path"))
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return rows.groupBy("asked").agg(F.min_by(F.struct("name", "path"), F.struct("prio", "pos")).alias("p")).select("asked", "p.name", "p.path")
