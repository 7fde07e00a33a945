"""Document retrieval end to end: directory -> chunks -> index -> answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import outline
from ..functions.vectors import Md5Embedding, ModelScorer, Provider, normalize
from ..operators import chunk, retrieve, sync
from ..sinks.tables import VersionedTable
from ..sources import scan
from .index import TextIndex


class Engine:
    """Incremental ingest of a directory and search over it; all state is in versioned tables below ``state``."""

    def __init__(self, spark: SparkSession, root: str, state: str, embed: Provider | None = None, scorer: ModelScorer | None = None):
        self.spark, self.root, self.embed, self.scorer = spark, root, embed or Md5Embedding(), scorer
        self.chunks = VersionedTable(spark, f"{state}/chunks", schemas.CHUNKS)
        self.documents = VersionedTable(spark, f"{state}/documents", schemas.DOCUMENTS, "doc_name")
        self.index = TextIndex(spark, state)
        self.manifest = VersionedTable(spark, f"{state}/manifest", schemas.MANIFEST)

    def embedded(self, rows: DataFrame) -> DataFrame:
        """(source, chunk_index, text) -> chunk records."""
        vector = normalize(self.embed.documents(F.col("text"))).cast("array<float>")
        return rows.select(sync.chunk_id(F.col("source"), F.col("chunk_index")).alias("id"), "source", F.col("chunk_index").cast("int").alias("chunk_index"), "text", vector.alias("vector"))

    def ingest(self, force: bool = False, cancelled: Callable[[], bool] = lambda: False) -> dict:
        """One run; errors are rows of the report.  The manifest is committed last, so an interrupted run is repeated."""
        files = scan.files(self.spark, self.root)
        old = self.manifest.read()
        status = sync.diff(files.select("source", "mtime", "size"), old, force).persist()
        todo = status.where("status <> 'unchanged'").select("source")
        if cancelled():
            status.unpersist()
            return {"cancelled": True}
        parsed = scan.documents(files.join(todo, "source", "left_semi").repartition("source"))  # parsing is spread by file, not by size
        pieces = chunk.hybrid(F.col("text"))
        parsed = parsed.withColumns({"pieces": F.when(F.col("status") == "ok", pieces), "content_hash": sync.content_hash(F.col("text"))})
        parsed = parsed.withColumn("chunk_count", F.coalesce(F.size("pieces"), F.lit(0))).persist()
        gone = sync.deleted(files, old).persist()
        report = sync.stats(status, parsed, gone).first().asDict() | {"cancelled": False}
        if cancelled():
            return report | {"cancelled": True}
        ok = parsed.where("status = 'ok'")
        keys = gone.unionByName(ok.select("source"))
        self.chunks.replace(keys, self.embedded(chunk.chunk_documents(ok, F.col("pieces"))))
        now = self.chunks.read().join(ok.select("source"), "source", "left_semi")
        self.index.replace(keys, now)
        made = outline.digests(ok, "source", "text").join(ok.select("source", "text"), "source")
        rows = made.select(sync.document_id(F.col("source")).alias("doc_id"), F.col("source").alias("doc_name"), "digest", F.col("text").alias("markdown"), "chapters")
        self.documents.replace(keys.withColumnRenamed("source", "doc_name"), rows)
        self.manifest.replace(gone.unionByName(todo), sync.next_manifest(parsed, old.limit(0)))
        for df in (status, parsed, gone):
            df.unpersist()
        return report

    def query_vector(self, query: str) -> list[float]:
        """The one row that is computed on its own."""
        one = self.spark.range(1).select(normalize(self.embed.queries(F.lit(query))).alias("v"))
        return list(one.first()["v"])

    def search(self, query: str, k: int = 3, source: str | None = None) -> DataFrame:
        """(id, source, chunk_index, text, rerank_score); texts are asked of the stored index, a scorer sees the merged candidates."""
        rows = self.chunks.read()
        where = None if source is None else F.col("source").contains(source)
        terms = [r["w"] for r in self.spark.range(1).select(F.explode(retrieve.words(F.lit(query))).alias("w")).collect()]
        many = k * retrieve.OVERFETCH
        near = retrieve.vector_search(rows, self.query_vector(query), many, where=where, keys=("id",)).select("id", "score")
        said = self.index.search(terms, where).orderBy(F.desc("score"), "id").limit(many)
        both = retrieve.merge(near, said, ["id"]).join(rows.select("id", "source", "chunk_index", "text"), "id")
        if self.scorer is None:
            return retrieve.rerank_fallback(both, k)
        return retrieve.rerank_or_fallback(both, self.scorer.scores(query, F.col("text")), k)

    def search_text(self, query: str, k: int = 3, source: str | None = None, per_hit: int = 1500, total: int = 8000) -> str:
        """R11."""
        rows = retrieve.formatted(self.search(query, k, source), [F.desc("rerank_score"), F.col("merged")], per_hit, total)
        return "\n\n".join(r["entry"] for r in rows.orderBy("place").collect())

    def outline(self, name: str | None = None) -> DataFrame:
        """D14, D15."""
        docs = self.documents.read()
        if not name:
            return docs.where("doc_name <> ''").select("doc_name").distinct().orderBy("doc_name")
        return sync.find_document(docs, name)

    def refresh_digests(self) -> int:
        """Rebuild missing or stale outlines from the stored Markdown."""
        docs = self.documents.read()
        bad = docs.where(F.col("digest").isNull() | outline.is_stale(F.col("digest"))).persist()
        n = bad.count()
        if n:
            made = outline.digests(bad, "doc_name", "markdown").join(bad.select("doc_name", "doc_id", "markdown"), "doc_name")
            self.documents.upsert(made.select("doc_id", "doc_name", "digest", "markdown", "chapters"), "doc_id")
        bad.unpersist()
        return n

    def clear(self) -> None:
        for t in (self.chunks, self.index, self.documents, self.manifest):
            t.clear()

    def status(self) -> dict:
        return retrieve.status(self.chunks.read()).first().asDict()
