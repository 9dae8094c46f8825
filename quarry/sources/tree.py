"""Source trees, call logs and golden questions as DataFrames."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.chunkers.registry import FINDERS, extension, language_column

MAX_BYTES = 1 << 20
IGNORE_FILE = ".quarryignore"
SKIPPED = ".git node_modules vendor .venv venv __pycache__ .pytest_cache .mypy_cache .tox dist build target .next .nuxt".split()
CALL_SCHEMA = "ts string, tool string, args string, latency_ms bigint, response_bytes int, scores array<double>"
GOLDEN_SCHEMA = "questions array<struct<id:string,question:string,question_lang:string,type:string,language:string,expected_files:array<string>,expected_symbols:array<string>>>"


def glob_pattern(glob: str) -> str:
    """A shell pattern (no ``/`` in ``*`` and ``?``) as a regular expression of one path segment."""
    out = ""
    for c in re.findall(r"\[[^\]]*\]|.", glob):
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.startswith("[") and len(c) > 1 else re.escape(c))
    return out


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a relative path falls under the lines of an ignore file.

    A line with a slash (but for one at its end) is a path from the root, which no path
    meets if it begins with a slash; others are names or shell patterns at any level. A
    slash at the end means folders only; what is in an ignored folder is ignored."""
    verdict = F.lit(False)
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        folder, body = rule.endswith("/"), rule.removesuffix("/")
        if "/" in body:
            verdict |= F.startswith(path, F.lit(body + "/")) | (F.lit(not folder) & (path == body))
        elif body:
            names = f"(?:{re.escape(body)}|{glob_pattern(body)})"
            verdict |= path.rlike(f"(^|/){names}{'/' if folder else '(/|$)'}")
    return verdict


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, of whatever store Spark reads."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file of any store; None if there is none. Spark's readers pass over names with a leading dot or underscore."""
    target, store = hadoop_path(spark, path)
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def ignore_rules(spark: SparkSession, root: str, name: str = IGNORE_FILE) -> list[str]:
    """Lines of the ignore file at the root of a tree; none without one."""
    text = read_bytes(spark, f"{root.rstrip('/')}/{name}")
    return text.decode(errors="replace").split("\n") if text else []


def passed_over(spark: SparkSession, root: str, max_bytes: int) -> DataFrame:
    """``file_path, length, content`` of the files that Spark's readers pass over: empty
    ones, and those whose name, or the name of a folder above them, begins with a dot or
    underscore. They are part of one source tree and few, so the driver walks and reads them."""
    found, folders = [], [("", False)]
    while folders:
        at, hidden = folders.pop()
        target, store = hadoop_path(spark, f"{root.rstrip('/')}/{at}")
        for status in store.listStatus(target):
            name = status.getPath().getName()
            path, odd = f"{at}{name}", hidden or name[0] in "._"
            if status.isDirectory():
                if name not in SKIPPED:
                    folders.append((path + "/", odd))
            elif (odd or not status.getLen()) and extension(name) in FINDERS and status.getLen() <= max_bytes:
                found.append((path, status.getLen(), bytearray(read_bytes(spark, f"{root.rstrip('/')}/{path}") or b"")))
    return spark.createDataFrame(found, "file_path string, length bigint, content binary")


def source_files(spark: SparkSession, root: str, rules: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``file_path, language, n_bytes, hash, content``. Folders, suffixes and sizes are
    tested on the listing, before any content is read. ``rules`` are those of the tree's
    ignore file unless given."""
    rules = ignore_rules(spark, root) if rules is None else rules
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    target, store = hadoop_path(spark, root)
    base = store.makeQualified(target).toString().rstrip("/") + "/"
    seen = raw.select(F.substring("path", len(base) + 1, 1 << 30).alias("file_path"), "length", "content")
    suffixes = "|".join(re.escape(s) for s in FINDERS)
    skip = "|".join(re.escape(s) for s in SKIPPED)
    path = F.col("file_path")
    kept = [x.where((F.col("length") <= max_bytes) & path.rlike(f"(?i)({suffixes})$") & ~path.rlike(f"(^|/)({skip})/") & ~ignored(path,
        rules)) for x in (seen, passed_over(spark, root, max_bytes))]
    return kept[0].unionByName(kept[1]).select("file_path", language_column(path).alias("language"), F.col("length").alias("n_bytes"),
        F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content"))


def listing(files: DataFrame) -> DataFrame:
    """Paths and sizes in the order of the paths."""
    return files.select("file_path", "language", "n_bytes").orderBy("file_path")


def sub_folders(path: str) -> list[str]:
    """Names of a local folder's sub-folders in order, without hidden ones."""
    with os.scandir(path) as entries:
        return sorted(e.name for e in entries if e.is_dir() and not e.name.startswith("."))


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log; blank and malformed lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", CALL_SCHEMA).alias("c"))
    return parsed.where(F.col("c.tool").isNotNull()).select("c.*").withColumn("ts", F.try_to_timestamp("ts"))


def golden_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN_SCHEMA).option("multiLine", "true").json(path).select(F.inline("questions"))


def append_calls(calls: DataFrame, folder: str) -> None:
    calls.write.mode("append").json(folder)
