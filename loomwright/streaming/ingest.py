"""Streaming ingest: micro-batches of documents into the chunk table; stateful counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunk
from ..operators.skills import request_key
from ..sinks.tables import VersionedTable


def ingest(docs: DataFrame, table: VersionedTable, embedded: Callable[[DataFrame], DataFrame], checkpoint: str, on_batch: Callable[[int], None] | None = None, is_cancelled: Callable[[], bool] = lambda: False):
    """Each micro-batch replaces the chunks of the sources in it, so a repeated batch changes nothing.

    ``docs`` streams (source, text).  Of a source that comes twice in a batch
    the longest text counts.  Returns the query; it ends when what is there has been read.
    """

    def write(batch: DataFrame, n: int) -> None:
        if is_cancelled():
            raise InterruptedError("ingest was cancelled; committed batches stay")
        once = batch.groupBy("source").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        table.replace_by_source(embedded(chunk.chunk_documents(once, chunk.hybrid(F.col("text")))))
        if on_batch:
            on_batch(n)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def documents(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files (source, text), ``per_trigger`` files a batch."""
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def request_counts(requests: DataFrame, text: str = "text") -> DataFrame:
    """L05 as a stream: running counts by request key (complete or update mode)."""
    return requests.select(request_key(F.col(text)).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))


def daily_counts(facts: DataFrame, ts: str = "ts") -> DataFrame:
    """H08 as a stream: distinct facts by day, a tumbling window."""
    return facts.groupBy(F.window(ts, "1 day").alias("w")).agg(F.array_sort(F.collect_set("fact")).alias("facts")).select(F.to_date("w.start").alias("day"), "facts")
