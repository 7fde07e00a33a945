"""Shared scratch tables: lineage is cut by Parquet in the folder of ``spark.checkpoint.dir``.

Tables belong to the innermost open :func:`scope` and go with it.  Without a
scope they live as long as the application, as lazy results read them; the
file system deletes them when the JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for the deletion of an execution's shuffle files.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables(list):
    """(session, path) of a scope's tables, and the scope around it."""

    def __init__(self, above: Tables | None):
        super().__init__()
        self.above = above


_OWN: dict[str, str] = {}
_SCOPE: ContextVar[Tables | None] = ContextVar("scope", default=None)


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a local session (tests) gets a temporary one and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        path = _OWN[app]
    return path.rstrip("/")


def reserve(spark: SparkSession, name: str = "table", outer: bool = False) -> str:
    """A new path that is deleted with the scope (with the one around it if ``outer``), or with the application where none is open."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    tables = _SCOPE.get()
    if outer and tables is not None:
        tables = tables.above
    if tables is None:
        fs, p = _file_system(spark, path)
        fs.deleteOnExit(p)
    else:
        tables.append((spark, path))
    return path


def cut(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` once and return the table: survives the loss of any executor and is never recomputed."""
    return write(df, reserve(df.sparkSession, outer=outer))


def write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and return the table; its shuffle files are deleted then, as nothing reads them again."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Tables cut inside are deleted at the end; results that read them must have been written by then."""
    mine = Tables(_SCOPE.get())
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for spark, path in mine:
            delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
