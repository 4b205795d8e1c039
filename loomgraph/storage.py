"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}  # paths that this process wrote and did not yet discard
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)  # paths of the innermost scope of this thread


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is removed when this process ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _held[path] = spark
    if (here := _scope.get()) is not None:
        here.append(path)
    return path


def written(df: DataFrame, name: str, *folders: str, **options: str) -> DataFrame:
    """Write a table, in a folder a value of some columns, and read it again, which cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    out = df.write.options(**options)
    (out.partitionBy(*folders) if folders else out).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables from :func:`written` that no later plan reads; others are left alone."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path and _held.pop(path, None) is not None:
            remove(t.sparkSession, path)


@contextmanager
def scope(*kept: str) -> Iterator[None]:
    """Tables that this thread writes within go at its end, but those of the names kept: for what answers one question after another."""
    written_here: list[str] = []
    token = _scope.set(written_here)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in written_here:
            if path.rpartition("/")[2].rpartition("-")[0] not in kept and path in _held:
                remove(_held.pop(path), path)


@atexit.register
def discard_all() -> None:
    """What results still read when they were returned goes when the process ends."""
    while _held:
        path, spark = _held.popitem()
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended, and the folder is no longer reachable from here
            return
