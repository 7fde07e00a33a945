"""Incremental synchronisation: manifest diff, replace-by-source writes, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat(F.substring(F.md5(source), 1, 12), F.lit("_"), index.cast("string"))


def document_id(name: Column) -> Column:
    return F.substring(F.md5(name), 1, 12)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def diff(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """(source, mtime, size, status) with status new, modified or unchanged."""
    old = manifest.select("source", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    same = F.lit(not force) & (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    status = F.when(F.col("_known").isNull(), "new").when(same, "unchanged").otherwise("modified")
    return files.join(old, "source", "left").withColumn("status", status).drop("_m", "_s", "_known")


def deleted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources of the manifest that are gone."""
    return manifest.join(files.select("source"), "source", "left_anti").select("source")


def next_manifest(parsed: DataFrame, unchanged: DataFrame) -> DataFrame:
    """What was read well, and what was carried over; rows with an error are left out, so they are tried again."""
    ok = parsed.where("status = 'ok'").select("source", "mtime", "size", "content_hash", "chunk_count")
    return ok.unionByName(unchanged.select("source", "mtime", "size", "content_hash", "chunk_count"))


def replace_by_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """All rows of each source that ``new`` touches are replaced."""
    touched = new.select(source).distinct()
    return old.join(touched, source, "left_anti").unionByName(new.select(*old.columns))


def delete_by_source(rows: DataFrame, names: DataFrame | str, source: str = "source") -> DataFrame:
    """By one name or by a table of names."""
    if isinstance(names, str):
        return rows.where(~F.col(source).eqNullSafe(F.lit(names)))
    return rows.join(names.select(source).distinct(), source, "left_anti")


def last_wins(rows: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """One row per key, the one written last."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def classify(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, change) with change added, updated, removed or kept."""
    a = old.select(F.col(key), F.col(fingerprint).alias("_a"))
    b = new.select(F.col(key), F.col(fingerprint).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "updated").otherwise("kept")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def replace_first(text: Column, old: str, new: str) -> Column:
    """The first occurrence only."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)


def replace_all(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def stats(files: DataFrame, parsed: DataFrame, gone: DataFrame) -> DataFrame:
    """One row about a run."""
    found = files.agg(F.count("*").alias("files_found"), F.sum((F.col("status") == "unchanged").cast("int")).alias("files_skipped"))
    done = parsed.agg(
        F.sum((F.col("status") == "ok").cast("int")).alias("files_extracted"),
        F.sum(F.when(F.col("status") == "ok", F.length("text")).otherwise(0)).alias("total_chars"),
        F.sum("chunk_count").alias("chunks"),
        F.array_sort(F.array_agg(F.when(F.col("status") == "error", F.col("source")))).alias("errors"),
    )
    lost = gone.agg(F.count("*").alias("files_deleted"))
    return found.crossJoin(done).crossJoin(lost)  # one row each


def missing_digests(cache: DataFrame, documents: DataFrame, stale: Column) -> DataFrame:
    """Cached documents without a digest, or with a stale one."""
    known = documents.select("doc_name", F.col("digest").alias("_d"))
    return cache.join(known, "doc_name", "left").where(F.col("_d").isNull() | stale).drop("_d")


def find_document(documents: DataFrame, name: str) -> DataFrame:
    """Exact name (any case) first, else either name within the other; ties by name."""
    n, d = F.lower(F.lit(name)), F.lower("doc_name")
    base = F.regexp_extract(d, r"([^/]*)$", 1)
    rank = F.when((d == n) | (base == n), 0).when((F.lit(name) != "") & (d.contains(n) | F.contains(n, d)), 1)
    return documents.withColumn("_r", rank).where("_r is not null and doc_name <> ''").orderBy("_r", "doc_name").limit(1).drop("_r")
