"""Session defaults and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults of a session of our own; a session that is handed in keeps its settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "quarry", master: str | None = None, **conf: object) -> SparkSession:
    """A session with our defaults; names in ``conf`` use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is
    unset a local master, whose executors are on this machine, gets a temporary folder of
    our own; any other must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master!r} share")
        named = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Later stages start from files that outlive any executor, columns can be pruned,
    and the optimizer sees the true size. The files go when the driver ends, or with
    :func:`drop`.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def drop(*frames: DataFrame) -> None:
    """Deletes the files of tables that :func:`cut` has written; nothing that is still to be computed may read them."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def scratch(spark: SparkSession, kind: str = "quarry") -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:  # else the session has ended
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Deletes all that :func:`cut` has written; results built on it must be used before."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001  the gateway may be gone when the driver ends
            return


atexit.register(release)
