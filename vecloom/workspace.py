"""Shared scratch space: tables that cut lineage and survive lost executors.

Scratch tables belong to the innermost open ``scope``.  When it ends they are
deleted, but for those that it keeps: these go to the scope around it, and
without one live until ``clean`` or the end of the process, since results are
lazy and still read them.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: While a scratch table is written: rows can be long texts, so few go to Python at once, and Spark
#: deletes the write's shuffle files when it is done.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "400",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

_open = threading.local()
#: Scratch paths outside all scopes.
_left: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    When the setting is absent a session in one JVM (tests) gets a temporary
    folder; on a cluster its absence is an error, since a machine-local
    folder would not be visible to other executors.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="vecloom-")
    sc.setCheckpointDir(base)
    return base


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of the block; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scope:
    """The scratch paths made in a block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, *frames: DataFrame | str) -> None:
        """Leave these scratch tables (or paths) to the scope around this one."""
        kept = {f if isinstance(f, str) else getattr(f, "_scratch", None) for f in frames} - {None}
        for p in kept & set(self.paths):
            self.paths.remove(p)
            _register(p, outer=True)


def _scopes() -> list[Scope]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def _register(path: str, outer: bool = False) -> None:
    scopes = _scopes()[:-1] if outer else _scopes()
    (scopes[-1].paths if scopes else _left).append(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Delete the block's scratch tables at its end, except kept ones."""
    own = Scope(spark)
    _scopes().append(own)
    try:
        yield own
    finally:
        for p in own.paths:
            with contextlib.suppress(Exception):
                removed(spark, p)
        _scopes().remove(own)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables outside open scopes; results that still read them can't be computed again."""
    while _left:
        with contextlib.suppress(Exception):
            removed(spark, _left.pop())


@atexit.register
def _at_exit() -> None:
    for p in _left:
        local = p.removeprefix("file://") if p.startswith("file:///") else p.removeprefix("file:")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            clean(spark)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other query uses; it belongs to the innermost scope."""
    path = f"{work_dir(spark)}/vecloom/{tag}-{uuid.uuid4().hex[:12]}"
    _register(path)
    return path


def stored(df: DataFrame, tag: str, **options: Any) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work neither
    recomputes it nor depends on the executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with settings(spark, WRITING):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a scratch path through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a scratch table that no later result reads."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        removed(df.sparkSession, path)


def shared(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object of this package's classes: pickled by value, so that
    workers need no package to read it.  They call ``pickle.loads`` on it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))
