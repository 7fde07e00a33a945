"""Corpus pipeline: raw documents to token ids, five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.  A stage's scratch
tables (in the folder of ``spark.checkpoint.dir``) and its input are deleted
once its result has been written.

Cases, for every stage: an empty table stays empty; a document with a null or
empty text has no features, similar ones, passages or tokens, so only the
classifier and the draw decide on it, and its token ids are null or empty; rows
with a null id are never similar to any; rows of one id are kept or dropped by
their own text, and as near copies together; ties go to the smaller id; texts
are read whole; further columns, clashing names too, pass through to the last
stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import bpe, jaccard, mixing, quality, rindex, store


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine keeps."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of similar ones."""
    return jaccard.deduplicate(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return rindex.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the raked weights of their source, language and topic."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; ``round_trip`` says that they decode to the text."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), keep_text=False)


STAGES = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("passages", drop_passages),
    ("mixing", mix_sources),
    ("encode", encode),
]

#: The classifier is trained by gradient steps, which SQL can't express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; only its table is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = store.reserve(spark, f"pipeline-{name}")
        with store.scope():
            after = store.write(stage(spark, docs, sf_dir), path)
        if before:
            store.delete(spark, before)
        docs, before = after, path
    return docs
