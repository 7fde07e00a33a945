"""A full-text index of a table, built once and asked many times."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession

from .. import schemas
from ..operators import retrieve
from ..sinks.tables import VersionedTable

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a temporary one, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomwright-index-"))


class TextIndex:
    """Postings sorted by term and lengths by source; a change touches the buckets of its sources."""

    def __init__(self, spark: SparkSession, state: str, buckets: int = 16):
        self.postings = VersionedTable(spark, f"{state}/postings", schemas.POSTINGS, buckets=buckets, order="term")
        self.lengths = VersionedTable(spark, f"{state}/lengths", schemas.LENGTHS, buckets=4)

    def replace(self, sources: DataFrame, rows: DataFrame, key: str = "id", text: str = "text") -> None:
        """The rows of ``sources`` are those of ``rows`` from now on."""
        self.postings.replace(sources, retrieve.indexed_postings(rows, key, text))
        self.lengths.replace(sources, retrieve.indexed_lengths(rows, text))

    def search(self, terms: list[str], where: Column | None = None) -> DataFrame:
        """(id, score)."""
        return retrieve.bm25_indexed(self.postings.read(), self.lengths.read(), terms, where)

    def clear(self) -> None:
        self.postings.clear()
        self.lengths.clear()


def of_table(rows: DataFrame, key: str, text: str = "text") -> TextIndex:
    """The index of a stored table that doesn't change, built where the application has none yet."""
    spark = rows.sparkSession
    name = hashlib.md5("|".join([spark.sparkContext.applicationId, key, text, *sorted(rows.inputFiles())]).encode()).hexdigest()
    index = TextIndex(spark, f"{folder(spark)}/index-{name}")
    if not index.lengths.version():  # the lengths are committed last
        index.postings.commit(retrieve.indexed_postings(rows, key, text))
        index.lengths.commit(retrieve.indexed_lengths(rows, text))
    return index
