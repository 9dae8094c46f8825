"""Index tables per project: snapshots of chunks and manifests, written in restartable steps.

A project lives in ``<folder>/<key of its path>``. Each run writes a new snapshot
(``chunks`` and ``files`` as Parquet) and then replaces the small ``CURRENT`` file by a
rename, so readers see the old state or the new one. Changed files are chunked in batches
that are written by themselves; a run that broke off finds what it had finished and goes
on. Paths are those of any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.chunkers import registry
from quarry.functions.text import passage_text
from quarry.operators import tools
from quarry.sources.tree import hadoop_path, read_bytes

FILES_SCHEMA = "file_path string, hash string"
#: Changed files that are chunked and written in one step.
COMMIT_FILES = 2048


class Aborted(RuntimeError):
    """A run was told to stop; what it has written is used by the next."""


def project_key(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


def project_key_column(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside and renames, which stores do at once."""
    draft, store = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = hadoop_path(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(draft, target, options)


def _drop(spark: SparkSession, path: str) -> None:
    target, store = hadoop_path(spark, path)
    store.delete(target, True)


@dataclass(frozen=True)
class Stats:
    files: int
    chunks: int
    reindexed: int
    kept: int
    removed: int


class Store:
    """Index tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def base(self, project: str) -> str:
        return f"{self.folder}/{project_key(project)}"

    def meta(self, project: str) -> dict:
        """``project_root, chunker_version, snapshot``; empty for an unknown project."""
        text = read_bytes(self.spark, f"{self.base(project)}/CURRENT")
        return json.loads(text) if text else {}

    def read(self, project: str) -> tuple[DataFrame, DataFrame]:
        """Chunks and manifest of a project; empty ones if it is unknown."""
        snapshot = self.meta(project).get("snapshot")
        if not snapshot:
            return self.spark.createDataFrame([], registry.SCHEMA), self.spark.createDataFrame([], FILES_SCHEMA)
        at = f"{self.base(project)}/{snapshot}"
        return self.spark.read.schema(registry.SCHEMA).parquet(f"{at}/chunks"), self.spark.read.schema(FILES_SCHEMA).parquet(f"{at}/files")

    def _publish(self, project: str, chunks: DataFrame, files: DataFrame, version: int) -> None:
        before, snapshot = self.meta(project).get("snapshot"), f"snapshot-{uuid.uuid4().hex}"
        at = f"{self.base(project)}/{snapshot}"
        chunks.write.parquet(f"{at}/chunks")
        files.write.parquet(f"{at}/files")
        _write_text(self.spark, f"{self.base(project)}/CURRENT", json.dumps({"project_root": project, "chunker_version": version, "snapshot": snapshot}))
        if before:
            _drop(self.spark, f"{self.base(project)}/{before}")

    def rewrite(self, project: str, chunks: DataFrame, files: DataFrame, version: int = registry.VERSION) -> None:
        """Replaces all that a project has; others stay."""
        self._publish(project, chunks.select(*_names(registry.SCHEMA)), files.select(*_names(FILES_SCHEMA)), version)

    def update(self, project: str, files: DataFrame, version: int = registry.VERSION, abort: Callable[[], bool] = lambda: False,
        log: Callable[[str], None] = lambda line: None, commit: int = COMMIT_FILES) -> Stats:
        """Chunks only files (``file_path, hash, content``) that are new or changed, keeps the
        chunks of the others, and leaves out what has vanished. A table that another
        version of the chunkers made is not kept from. ``abort`` is asked before each batch."""
        old_chunks, old_files = self.read(project)
        if self.meta(project).get("chunker_version") != version:
            old_chunks, old_files = old_chunks.limit(0), old_files.limit(0)
        # A file without chunks in the table counts as new, as its hash stands on its chunks.
        known = old_files.join(old_chunks.select("file_path").distinct(), "file_path", "left_semi")
        now = files.select(*_names(FILES_SCHEMA))
        counts = {r["action"]: r["n"] for r in tools.plan_update(now, known).groupBy("action").agg(F.count("*").alias("n")).collect()}
        reindexed, kept, removed = (counts.get(k, 0) for k in ("reindex", "keep", "remove"))
        log(f"{project}: {reindexed} files to chunk, {kept} unchanged, {removed} gone")
        if self.meta(project) and not reindexed and not removed and self.meta(project)["chunker_version"] == version:
            return Stats(kept, old_chunks.count(), 0, kept, 0)
        changed = files.join(known.select("file_path", "hash"), ["file_path", "hash"], "left_anti")
        batches = max(1, -(-reindexed // commit))
        parts = []
        for k in range(batches if reindexed else 0):
            if abort():
                raise Aborted(f"{project}: stopped after {k} of {batches} batches")
            parts.append(self._chunked(project, changed.where(F.pmod(F.xxhash64("file_path"), F.lit(batches)) == k), f"{version}-{batches}-{k}", log))
        same = old_chunks.join(now.join(known, ["file_path", "hash"], "left_semi").select("file_path"), "file_path", "left_semi")
        for part in parts:
            same = same.unionByName(part)
        self._publish(project, same, now, version)
        _drop(self.spark, f"{self.base(project)}/pending")
        return Stats(reindexed + kept, self.read(project)[0].count(), reindexed, kept, removed)

    def _chunked(self, project: str, files: DataFrame, name: str, log: Callable[[str], None]) -> DataFrame:
        """Chunks of a batch. A batch is named by what is in it, so one that was finished before is read."""
        seal = files.agg(F.sum(F.xxhash64("file_path", "hash").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).first()
        path = f"{self.base(project)}/pending/{name}-{seal['n']}-{seal['s']}"
        done, store = hadoop_path(self.spark, f"{path}/_SUCCESS")
        if store.exists(done):
            log(f"{project}: batch {name} was written before")
        else:
            registry.chunk_files(files).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(registry.SCHEMA).parquet(path)

    def migrate(self, legacy: DataFrame, version: int = registry.VERSION) -> list[str]:
        """Splits an old table of all projects (a column ``project``) into one per project. Of
        rows with one id the first by file and line stays; projects that are there already stay."""
        projects = [r["project"] for r in legacy.select("project").distinct().orderBy("project").collect()]  # one name each, not rows
        for project in projects:
            if not self.meta(project):
                own = legacy.where(F.col("project") == project)
                first = F.row_number().over(_by_id())
                chunks = own.withColumn("place", first).where("place = 1").drop("place")
                self.rewrite(project, chunks, chunks.select("file_path", "hash").distinct(), version)
        return projects


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("chunk_id").orderBy("file_path", "start_line")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


LEGACY_JSON = "project_root string, chunker_version int, manifest map<string,string>, chunks array<struct<id:string,file_path:string,language:string,start_line:int,end_line:int,symbol_name:string,kind:string,signature:string,doc:string,content:string,hash:string>>"


def read_json_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """Meta, chunks and manifest of an index in one JSON file."""
    whole = spark.read.schema(LEGACY_JSON).option("multiLine", "true").json(path)
    meta = whole.select("project_root", "chunker_version").first().asDict()
    empty = F.lit("")
    chunks = whole.select(F.inline("chunks")).withColumnRenamed("id",
        "chunk_id").select(*(F.coalesce(c, empty).alias(c) if c in ("signature", "doc") else F.col(c) for c in _names(registry.SCHEMA)))
    return meta, chunks, whole.select(F.explode("manifest").alias("file_path", "hash"))


def read_jdbc_index(spark: SparkSession, url: str, project: str, **options: str) -> tuple[dict, DataFrame]:
    """Meta and chunks of a project kept in a relational database, one table per project.

    Partitioning options of Spark's reader may be given to read in parallel."""
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    rows = reader().option("query", f"SELECT \"key\", \"value\" FROM meta WHERE \"project\" = '{project.replace(chr(39), chr(39) * 2)}'").load().collect()  # three rows
    return {r[0]: r[1] for r in rows}, reader().option("dbtable", f"chunks_{project_key(project)}").load()


def need_passages(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks without a vector of their present hash, with their ``passage``, in each partition by its length, so that batches are of one size."""
    need = tools.need_embedding(chunks, existing).withColumn("passage", passage_text("symbol_name", "signature", "doc", "content"))
    return need.sortWithinPartitions(F.octet_length("passage"), "chunk_id")


def summary(chunks: DataFrame, columns: Sequence[str] = ("language", "kind")) -> dict:
    """Counts of files and chunks, and of chunks by value of a few columns."""
    from quarry.operators.stats import top_counts

    row = chunks.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks")).first()
    return row.asDict() | {c: {r["name"]: r["count"] for r in top_counts(chunks, c, 8).collect()} for c in columns}
