"""Versioned Parquet tables in buckets: a write makes new bucket folders, a numbered commit file lists the current ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this write is visible."""


class VersionedTable:
    """A table that is never overwritten while it is read; the highest commit counts.

    Rows lie in ``buckets`` folders by the hash of ``key``, so a change rewrites
    the buckets of the keys it touches.  A commit is one rename of a complete
    file to the next number, which fails where that number is taken: a crash
    before it leaves the version before, and of two writers one starts again.
    ``order`` sorts the files, so that statistics of row groups prune by it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "source", buckets: int = 16, order: str | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.buckets, self.order = key if key in schema.names else schema.names[0], buckets, order

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """Number of the current commit, 0 where there is none."""
        fs, path = self._fs()
        folder = path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        """Folder of each bucket that has rows."""
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.root}/commits/{version:020d}.json", wholetext=True).collect()  # a file of one line
        return json.loads(rows[0][0])["folders"]

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in sorted(folders)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(list(self._folders(self.version()).values()))

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """New folders by bucket."""
        name = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*self.schema.names).withColumn("_bucket", self._bucket(self.key)).hint("rebalance", "_bucket")  # large buckets are split, small ones packed
        rows = rows.sortWithinPartitions("_bucket", *([self.order] if self.order else []))
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/{name}")) if s.isDirectory()]
        return {f.split("=")[1]: f"{name}/{f}" for f in found}

    def _publish(self, version: int, folders: dict[str, str]) -> int:
        fs, path = self._fs()
        context = self.spark.sparkContext
        fs.mkdirs(path(f"{self.root}/commits"))
        tmp, to = path(f"{self.root}/commits/.{uuid.uuid4().hex}"), path(f"{self.root}/commits/{version:020d}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        hadoop = context._jvm.org.apache.hadoop.fs
        try:
            hadoop.FileContext.getFileContext(tmp.toUri(), context._jsc.hadoopConfiguration()).rename(tmp, to, context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Exception as e:
            fs.delete(tmp, False)
            if fs.exists(to):
                raise Conflict(f"version {version} of {self.root} was committed by another writer") from e
            raise
        return version

    def commit(self, rows: DataFrame) -> int:
        """``rows`` become the table."""
        version = self.version()
        return self._publish(version + 1, self._write(rows))

    def replace(self, keys: DataFrame, rows: DataFrame | None = None, key: str | None = None, tries: int = 3) -> int:
        """Rows whose ``key`` is in ``keys`` go and ``rows`` come; only buckets with such keys are read and written.

        Where ``key`` isn't what the buckets go by, all of them are.
        """
        key = key or self.key
        keys = keys.select(F.col(key)).distinct()
        for left in reversed(range(tries)):
            version = self.version()
            folders = self._folders(version)
            touched = set(folders)
            if key == self.key:
                touched = {str(r[0]) for r in keys.select(self._bucket(key)).distinct().collect()}  # as many as buckets
                if rows is not None:
                    touched |= {str(r[0]) for r in rows.select(self._bucket(key)).distinct().collect()}
            mine = self._read([f for b, f in folders.items() if b in touched])
            kept = mine.join(keys, mine[key].eqNullSafe(keys[key]), "left_anti")
            new = self._write(kept if rows is None else kept.unionByName(rows.select(*self.schema.names)))
            try:
                return self._publish(version + 1, {b: f for b, f in folders.items() if b not in touched} | new)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def replace_by_source(self, rows: DataFrame) -> int:
        return self.replace(rows, rows, "source")

    def delete_by_source(self, names: DataFrame | str) -> int:
        return self.replace(self.spark.createDataFrame([(names,)], "source string") if isinstance(names, str) else names, None, "source")

    def upsert(self, rows: DataFrame, key: str) -> int:
        return self.replace(rows, rows, key)

    def clear(self) -> int:
        return self._publish(self.version() + 1, {})

    def vacuum(self) -> None:
        """Delete what the current version doesn't use; not while others read older versions or write."""
        fs, path = self._fs()
        version = self.version()
        folders = self._folders(version)
        used = {f.split("/")[1] for f in folders.values()}
        if fs.exists(path(f"{self.root}/data")):
            for s in fs.listStatus(path(f"{self.root}/data")):
                name = s.getPath().getName()
                if name not in used:
                    fs.delete(s.getPath(), True)
                    continue
                for b in fs.listStatus(s.getPath()):
                    if b.isDirectory() and f"data/{name}/{b.getPath().getName()}" not in folders.values():
                        fs.delete(b.getPath(), True)
        for s in fs.listStatus(path(f"{self.root}/commits")) if version else []:
            if s.getPath().getName() != f"{version:020d}.json":
                fs.delete(s.getPath(), False)
