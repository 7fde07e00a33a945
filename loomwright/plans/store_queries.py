"""Queries over stores: vectors, retrieval, sync, graph, skills, conversations, dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunk as K
from ..operators import conversation as H
from ..operators import deps, graph, retrieve, skills, sync
from . import index
from .registry import query

_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


def _md5_sql(x: str, n: int = 16) -> str:
    return "[" + ", ".join(f"('0x' || substr(md5({x}), {2 * k + 1}, 2))::INT / 255.0" for k in range(n)) + "]::DOUBLE[]"


@query("v03_normalize", f"SELECT vec_id, list_transform(v, lambda x: round(x * 3 / (3 * sqrt({_DOT.format('v', 'v')})), 6)) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def v03(t):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return t("embeddings").select("vec_id", F.transform(V.normalize(tripled), lambda x: V.rounded(x, 6)).alias("v"))


_FIRST = "(SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _query_vector(e, n: int = 0) -> list[float]:
    """The vector of the n-th smallest id: what a search is asked with."""
    return list(e.orderBy("vec_id").select("embedding").limit(n + 1).collect()[n][0])


@query("v04_similarity", f"SELECT vec_id, round(greatest(0, {_DOT.format('embedding', 'q')}), 4) AS score FROM embeddings, {_FIRST}")
def v04(t):
    e = t("embeddings")
    return e.select("vec_id", F.round(V.similarity(F.col("embedding"), V.literal(_query_vector(e))), 4).alias("score"))


@query("k16_cosine", f"SELECT vec_id, round({_DOT.format('embedding', 'q')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')})), 4) AS c FROM embeddings, {_FIRST}")
def k16(t):
    e = t("embeddings")
    return e.select("vec_id", V.rounded(V.cosine(F.col("embedding"), V.literal(_query_vector(e))), 4).alias("c"))


@query("v07_md5_embedding", f"SELECT doc_id, list_transform({_md5_sql('text')}, lambda x: round(x, 6)) AS v FROM documents")
def v07(t):
    return t("documents").select("doc_id", F.transform(V.Md5Embedding(1).documents(F.col("text")), lambda x: F.round(x, 6)).alias("v"))


@query("v07_bigram_embedding", "SELECT item_id, slot::INT AS slot, count(*) AS n FROM (SELECT item_id, ('0x' || substr(md5(substr(text, i::INT, 2)), 31, 2))::INT % 128 AS slot FROM (SELECT item_id, text, unnest(range(1, length(text))) AS i FROM benchmark)) GROUP BY ALL")
def v07b(t):
    rows = t("benchmark").select("item_id", F.posexplode(V.BigramEmbedding().documents(F.col("text"))).alias("slot", "n"))
    return rows.where("n > 0").select("item_id", "slot", F.col("n").cast("long").alias("n"))


@query("r01_vector_top_k", f"SELECT vec_id, round(greatest(0, {_DOT.format('embedding', 'q')}), 4) AS score FROM embeddings, {_FIRST} ORDER BY greatest(0, {_DOT.format('embedding', 'q')}) DESC, vec_id LIMIT 10")
def r01(t):
    e = t("embeddings")
    return retrieve.vector_search(e, _query_vector(e), 10, "embedding", keys=("vec_id",)).select("vec_id", F.round("score", 4).alias("score"))


@query("r02_tokens", f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS h FROM (SELECT doc_id, {X.WORDS_SQL.format('text')} AS w FROM documents)")
def r02(t):
    return t("documents").select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("h"))


@query("r03_postings", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({X.WORDS_SQL.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def r03(t):
    return retrieve.postings(t("documents"), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


TERMS = ["the", "and", "that", "with"]


@query("r04_bm25", retrieve.bm25_sql("documents", "doc_id", "text", TERMS, 12))
def r04(t):
    """From the stored index."""
    rows = index.of_table(t("documents"), "doc_id").search(TERMS)
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.round("score", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(12)


@query("r04_bm25_all", retrieve.bm25_sql("documents", "doc_id", "text", TERMS))
def r04a(t):
    return retrieve.bm25(t("documents"), TERMS, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


#: A knowledge base of document vectors: the md5 embedding of each text; the query is a benchmark item's.
_VECTORS = f"(SELECT doc_id, source, text, list_transform({_md5_sql('text')}, lambda x: x) AS v FROM documents)"
_Q = f"(SELECT list_transform({_md5_sql('text')}, lambda x: x) AS q FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"
_UNIT = f"greatest(0, {_DOT.format('v', 'q')} / (sqrt({_DOT.format('v', 'v')}) * sqrt({_DOT.format('q', 'q')})))"
_CHANNELS = f"""
va AS (SELECT doc_id, source, text, round({_UNIT}, 9) AS score FROM {_VECTORS}, {_Q} {{where}} ORDER BY score DESC, doc_id LIMIT 12),
ta AS (SELECT doc_id, score FROM ({{bm25}}) ORDER BY score DESC, doc_id LIMIT 12),
mg AS (SELECT doc_id, score, channel, place FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY channel, place) AS n FROM (
    SELECT doc_id, score, 0 AS channel, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM va
    UNION ALL SELECT doc_id, score, 1, row_number() OVER (ORDER BY score DESC, doc_id) FROM ta)) WHERE n = 1),
rs AS (SELECT *, row_number() OVER (ORDER BY channel, place) AS merged, CASE WHEN score > 1 THEN greatest(0, 1 - score * score / 2) ELSE score END AS rerank_score FROM mg)"""


def _hybrid_sql(final: str, where: str = "", docs: str = "documents") -> str:
    bm = retrieve.bm25_sql(docs, "doc_id", "text", TERMS).replace(", 4) AS score", ", 9) AS score")
    return "WITH " + _CHANNELS.format(where=where, bm25=bm) + final


def _channels(t, where=None):
    docs = t("documents") if where is None else t("documents").where(where)
    embed = V.Md5Embedding(1)
    q = t("benchmark").orderBy("item_id").limit(1).select(V.normalize(embed.queries(F.col("text")))).first()[0]
    rows = docs.withColumn("v", V.normalize(embed.documents(F.col("text"))))
    a = retrieve.vector_search(rows, list(q), 12, "v", keys=("doc_id",)).select("doc_id", F.round("score", 9).alias("score"))
    b = index.of_table(t("documents"), "doc_id").search(TERMS, where).select(F.col("id").cast("long").alias("doc_id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(12)
    return a, b


@query("r05_merge", _hybrid_sql("SELECT doc_id, channel, merged, round(score, 4) AS score FROM rs"))
def r05(t):
    return retrieve.merge(*_channels(t), ["doc_id"]).select("doc_id", "channel", F.col("merged").cast("long").alias("merged"), F.round("score", 4).alias("score"))


@query("r06_rerank", _hybrid_sql("SELECT doc_id, round(s, 4) AS rerank_score FROM (SELECT doc_id, 1 / (1 + exp(-(length(text) % 7 - 2))) AS s, merged FROM rs JOIN documents USING (doc_id) ORDER BY s DESC, merged LIMIT 5) WHERE s >= 0.7"))
def r06(t):
    """The scorer's place is taken by a sigmoid of the length; a model is an Arrow UDF in that place."""
    rows = retrieve.merge(*_channels(t), ["doc_id"]).join(t("documents").select("doc_id", "text"), "doc_id")
    return retrieve.rerank(rows, 1 / (1 + F.exp(-(F.length("text") % 7 - 2))), 5).select("doc_id", F.round("rerank_score", 4).alias("rerank_score"))


@query("r07_rerank_fallback", _hybrid_sql("SELECT doc_id, round(rerank_score, 4) AS rerank_score FROM rs ORDER BY rs.rerank_score DESC, merged LIMIT 20"))
def r07(t):
    return retrieve.rerank_fallback(retrieve.merge(*_channels(t), ["doc_id"]), 20).select("doc_id", F.round("rerank_score", 4).alias("rerank_score"))


@query("r08_at_least", f"SELECT vec_id FROM (SELECT vec_id, round(greatest(0, {_DOT.format('embedding', 'q')}), 6) AS score FROM embeddings, {_FIRST}) WHERE score >= 0.25")
def r08(t):
    e = t("embeddings")
    rows = e.withColumn("score", F.round(V.similarity(F.col("embedding"), V.literal(_query_vector(e))), 6))
    return retrieve.at_least(rows, 0.25).select("vec_id")


@query("r09_hybrid_search", _hybrid_sql("SELECT doc_id, round(rerank_score, 4) AS score FROM rs ORDER BY rs.rerank_score DESC, merged LIMIT 3"))
def r09(t):
    return retrieve.rerank_fallback(retrieve.merge(*_channels(t), ["doc_id"]), 3).select("doc_id", F.round("rerank_score", 4).alias("score"))


@query("r10_search_in_source", _hybrid_sql("SELECT doc_id, round(rerank_score, 4) AS score FROM rs ORDER BY rs.rerank_score DESC, merged LIMIT 3", "WHERE contains(source, 'rc1')", "(SELECT * FROM documents WHERE contains(source, 'rc1'))"))
def r10(t):
    a, b = _channels(t, F.col("source").contains("rc1"))
    return retrieve.rerank_fallback(retrieve.merge(a, b, ["doc_id"]), 3).select("doc_id", F.round("rerank_score", 4).alias("score"))


@query("r11_formatted", _hybrid_sql("""SELECT place, md5(entry) AS h FROM (
  SELECT *, coalesce(sum(length(entry)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT place, '[' || place || '] ' || source || chr(10) || CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '…' ELSE text END AS entry
    FROM (SELECT doc_id, row_number() OVER (ORDER BY rerank_score DESC, merged) AS place FROM rs) JOIN documents USING (doc_id))) WHERE before < 8000"""))
def r11(t):
    rows = retrieve.rerank_fallback(retrieve.merge(*_channels(t), ["doc_id"]), 100).join(t("documents").select("doc_id", "source", "text"), "doc_id")
    return retrieve.formatted(rows, [F.desc("rerank_score"), F.col("merged")]).select(F.col("place").cast("long").alias("place"), F.md5("entry").alias("h"))


@query("r12_status", "SELECT count(*) AS chunks, count(DISTINCT CASE WHEN source <> '' THEN source END) AS sources, count(*) > 0 AS has_kb FROM documents")
def r12(t):
    return retrieve.status(t("documents"))


@query("r12_sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def r12s(t):
    return retrieve.sources(t("documents"))


# Sync: two snapshots of files made from documents


_OLD = "(SELECT doc_id::VARCHAR AS source, n_chars::DOUBLE AS mtime, n_chars AS size FROM documents WHERE doc_id % 3 <> 0)"
_NEW = "(SELECT doc_id::VARCHAR AS source, n_chars::DOUBLE + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime, n_chars AS size FROM documents WHERE doc_id % 4 <> 0)"


def _snapshots(t):
    d = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), F.col("n_chars").cast("double").alias("mtime"), F.col("n_chars").alias("size"))
    old = d.where("doc_id % 3 <> 0").drop("doc_id")
    new = d.where("doc_id % 4 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).drop("doc_id")
    return old, new


@query("i02_manifest_diff", f"SELECT n.source, CASE WHEN o.source IS NULL THEN 'new' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged' ELSE 'modified' END AS status FROM {_NEW} n LEFT JOIN {_OLD} o ON o.source = n.source")
def i02(t):
    old, new = _snapshots(t)
    return sync.diff(new, old).select("source", "status")


@query("i03_deleted_sources", f"SELECT source FROM {_OLD} WHERE source NOT IN (SELECT source FROM {_NEW})")
def i03(t):
    old, new = _snapshots(t)
    return sync.deleted(new, old)


_PARSED = f"(SELECT doc_id::VARCHAR AS source, CASE WHEN doc_id % 10 = 3 THEN 'error' ELSE 'ok' END AS status, text, n_chars FROM documents JOIN (SELECT n.source AS touched FROM {_NEW} n LEFT JOIN {_OLD} o USING (source, mtime, size) WHERE o.source IS NULL) ON touched = doc_id::VARCHAR)"


def _parsed(t, status):
    """What the new and modified files gave."""
    d = t("documents").select(F.col("doc_id").cast("string").alias("source"), "text", F.lit(1).alias("chunk_count"), F.when(F.col("doc_id") % 10 == 3, "error").otherwise("ok").alias("status"))
    return d.join(status.where("status <> 'unchanged'").select("source"), "source", "left_semi")


@query("i08_next_manifest", f"SELECT source, n_chars AS size, substr(sha256(text), 1, 16) AS content_hash FROM {_PARSED} WHERE status = 'ok' UNION ALL SELECT n.source, n.size, 'kept' FROM {_NEW} n JOIN {_OLD} o USING (source, mtime, size)")
def i08(t):
    old, new = _snapshots(t)
    status = sync.diff(new, old)
    kept = status.where("status = 'unchanged'").select("source", "mtime", "size", F.lit("kept").alias("content_hash"), F.lit(1).alias("chunk_count"))
    parsed = _parsed(t, status).join(status.select("source", "mtime", "size"), "source").withColumn("content_hash", sync.content_hash(F.col("text")))
    return sync.next_manifest(parsed, kept).select("source", "size", "content_hash")


@query("i04_ingest_stats", f"SELECT (SELECT count(*) FROM {_NEW}) AS files_found, (SELECT count(*) FROM {_NEW} n JOIN {_OLD} o USING (source, mtime, size)) AS files_skipped, (SELECT count(*) FROM {_PARSED} WHERE status = 'ok') AS files_extracted, (SELECT sum(length(text))::BIGINT FROM {_PARSED} WHERE status = 'ok') AS total_chars, (SELECT count(*) FROM {_OLD} WHERE source NOT IN (SELECT source FROM {_NEW})) AS files_deleted, (SELECT count(*) FROM {_PARSED} WHERE status = 'error') AS errors")
def i04(t):
    old, new = _snapshots(t)
    status = sync.diff(new, old)
    r = sync.stats(status, _parsed(t, status), sync.deleted(new, old))
    return r.select("files_found", F.col("files_skipped").cast("long").alias("files_skipped"), "files_extracted", "total_chars", "files_deleted", F.size("errors").cast("long").alias("errors"))


@query("p01_replace_by_source", "SELECT source, doc_id, 'old' AS version FROM documents WHERE doc_id % 2 = 0 AND source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 1 AND source IN ('src1', 'src2')) UNION ALL SELECT source, doc_id, 'new' FROM documents WHERE doc_id % 2 = 1 AND source IN ('src1', 'src2')")
def p01(t):
    d = t("documents")
    old = d.where("doc_id % 2 = 0").select("source", "doc_id", F.lit("old").alias("version"))
    new = d.where("doc_id % 2 = 1 and source in ('src1', 'src2')").select("source", "doc_id", F.lit("new").alias("version"))
    return sync.replace_by_source(old, new)


@query("p03_delete_by_source", "SELECT doc_id FROM documents WHERE source <> 'src3'")
def p03(t):
    return sync.delete_by_source(t("documents"), "src3").select("doc_id")


@query("p05_upsert_document", "SELECT substr(md5(user_id::VARCHAR), 1, 12) AS doc_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def p05(t):
    rows = t("events").select(sync.document_id(F.col("user_id").cast("string")).alias("doc_id"), "event_id")
    return sync.last_wins(rows, "doc_id", F.col("event_id"))


@query("p06_delete_document", "SELECT doc_id FROM documents WHERE substr(md5(doc_id::VARCHAR), 1, 12) <> substr(md5('5'), 1, 12)")
def p06(t):
    return t("documents").where(sync.document_id(F.col("doc_id").cast("string")) != sync.document_id(F.lit("5"))).select("doc_id")


@query("p12_skill_sync", "SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.f <> n.f THEN 'updated' ELSE 'kept' END AS change FROM (SELECT p_partkey AS k, md5(p_name) AS f FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey AS k, md5(p_name || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END) AS f FROM part WHERE p_partkey % 5 <> 0) n ON o.k = n.k")
def p12(t):
    p = t("part").select(F.col("p_partkey").alias("k"), "p_name")
    old = p.where("k % 3 <> 0").select("k", F.md5("p_name").alias("f"))
    new = p.where("k % 5 <> 0").select("k", F.md5(F.concat("p_name", F.when(F.col("k") % 7 == 0, "x").otherwise(""))).alias("f"))
    return sync.classify(old, new, "k", "f")


@query("p13_replace_text", "SELECT doc_id, md5(replace(text, 'the', 'THE')) AS every, md5(CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || 'THE' || substr(text, instr(text, 'the') + 3) ELSE text END) AS first FROM documents")
def p13(t):
    return t("documents").select("doc_id", F.md5(sync.replace_all(F.col("text"), "the", "THE")).alias("every"), F.md5(sync.replace_first(F.col("text"), "the", "THE")).alias("first"))


@query("p09_key_value_last", "SELECT event_type || '/' || (user_id % 50) AS key, props FROM events QUALIFY row_number() OVER (PARTITION BY event_type || '/' || (user_id % 50) ORDER BY event_id DESC) = 1")
def p09(t):
    rows = t("events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 50).cast("string")).alias("key"), "props", "event_id")
    return sync.last_wins(rows, "key", F.col("event_id")).select("key", "props")


# Graph: customers and nations are entities, their account balances observations, foreign keys relations

_CALLS = "(SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN ' ' || lower(n_name) ELSE n_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS type, [' seg ' || c_mktsegment, '', 'bal ' || (c_custkey % 13)] AS obs FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _calls(t):
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.select(
        F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.col("n_name")).alias("name"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("type"),
        F.array(F.concat(F.lit(" seg "), "c_mktsegment"), F.lit(""), F.concat(F.lit("bal "), (F.col("c_custkey") % 13).cast("string"))).alias("observations"),
    )


_OBS = f"(SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq, pos) AS ord, text FROM (SELECT key, text, seq, pos FROM (SELECT lower(trim(name)) AS key, seq, i AS pos, trim(obs[i]) AS text FROM (SELECT *, unnest(range(1, len(obs) + 1)) AS i FROM {_CALLS})) WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY key, text ORDER BY seq, pos) = 1))"


@query("g01_create_entity", f"SELECT lower(trim(name)) AS key, arg_min(name, seq) AS name, arg_min(CASE WHEN type <> '' THEN type END, CASE WHEN type <> '' THEN seq END) AS type FROM {_CALLS} GROUP BY 1")
def g01(t):
    return graph.upsert_entities(_calls(t))


@query("g01_observations", f"SELECT * FROM {_OBS}")
def g01o(t):
    return graph.observations(_calls(t))


@query("g02_add_observations", f"SELECT key, text FROM {_OBS} WHERE text NOT IN ('bal 3', 'bal 4')")
def g02(t):
    obs = graph.observations(_calls(t))
    return graph.new_observations(obs.where("text in ('bal 3', 'bal 4')"), _calls(t)).select("key", "text")


_EDGES = "(SELECT seq, source, target, label FROM (SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS source, n_name AS target, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'in' END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE trim(label) <> '' QUALIFY row_number() OVER (PARTITION BY lower(source), lower(target), lower(label) ORDER BY seq) = 1)"


def _edges(t):
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("source"), F.col("n_name").alias("target"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise("in").alias("label"))
    return graph.relations(rows)


@query("g03_create_relation", f"SELECT source, target, label, seq FROM {_EDGES}")
def g03(t):
    return _edges(t)


@query("g03_endpoints", f"SELECT lower(name) AS key, min(name) AS name FROM (SELECT unnest([source, target]) AS name FROM {_EDGES}) GROUP BY 1")
def g03e(t):
    return graph.endpoints(_edges(t))


@query("g04_delete_entity", f"SELECT source, target FROM {_EDGES} WHERE lower(source) <> 'building' AND lower(target) NOT IN ('building', 'nation_3')")
def g04(t):
    gone = t("nation").limit(1).select(F.explode(F.array(F.lit("Building "), F.lit("NATION_3"))).alias("name"))
    obs = graph.observations(_calls(t))
    return graph.delete_entities(graph.upsert_entities(_calls(t)), _edges(t), obs, gone)[1].select("source", "target")


@query("g05_get_entity", f"SELECT ord, text FROM {_OBS} WHERE key = 'nation_3'")
def g05(t):
    return graph.observations(_calls(t)).where(F.col("key") == graph.key_of(F.lit(" Nation_3 "))).select("ord", "text")


@query("g06_observation_ids", f"SELECT substr(md5(key || '|' || text), 1, 16) AS id, key AS entity FROM {_OBS}")
def g06(t):
    return graph.observations(_calls(t)).select(graph.observation_id(F.col("key"), F.col("text")).alias("id"), F.col("key").alias("entity"))


@query("g07_backfill", f"SELECT substr(md5(key || '|' || text), 1, 16) AS id FROM {_OBS} WHERE text NOT LIKE 'bal%'")
def g07(t):
    pairs = graph.observations(_calls(t)).select(F.col("key").alias("entity"), "text")
    known = pairs.where("text like 'bal%'").select(graph.observation_id(F.col("entity"), F.col("text")).alias("id"))
    return graph.backfill(pairs, known).select("id")


@query("g08_semantic_search", f"SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, greatest(0, {_DOT.format('embedding', 'q')}) AS s FROM embeddings, {_FIRST} ORDER BY s DESC, vec_id LIMIT 8) WHERE s >= 0.3")
def g08(t):
    e = t("embeddings")
    return graph.semantic_search(e, _query_vector(e), 8, 0.3, "embedding", ("vec_id",)).select("vec_id", "score")


@query("g09_keyword_search", f"SELECT key, text, 0.5::DOUBLE AS score FROM {_OBS} WHERE contains(lower(text), 'bal 1')")
def g09(t):
    return graph.keyword_search(graph.observations(_calls(t)), "BAL 1").select("key", "text", "score")


@query("g10_snapshot", f"SELECT key, count(*) AS n, array_to_string(list(text ORDER BY ord)[1:3], '; ') AS summary FROM {_OBS} GROUP BY key ORDER BY n DESC, key LIMIT 10")
def g10(t):
    return graph.snapshot(graph.observations(_calls(t)))


@query("g11_g12_apply_extraction", "SELECT turn, name, type, 2 AS n FROM (SELECT conv_id * 100 + turn AS turn, 'Conv ' || conv_id AS name, role AS type FROM conversations WHERE conv_id % 3 <> 0)")
def g12(t):
    body = F.format_string('{"entities": [{"name": "Conv %d", "type": "%s", "observations": ["turn %d", "x"]}], "relations": []}', "conv_id", "role", "turn")
    reply = F.when(F.col("conv_id") % 3 == 0, F.lit("I found nothing {")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    ents, _ = graph.apply_extraction(t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), reply.alias("r")), "r")
    return ents.select(F.col("seq").alias("turn"), "name", "type", F.size("observations").alias("n"))


@query("g13_migrate_facts", "SELECT DISTINCT 'general' AS key, event_type || ' ' || (user_id % 20) AS text FROM events WHERE NOT (event_type || ' ' || (user_id % 20) LIKE '% 7')")
def g13(t):
    fact = F.concat_ws(" ", "event_type", (F.col("user_id") % 20).cast("string"))
    rows = t("events").select(fact.alias("fact"))
    known = rows.where("fact like '% 7'").select(F.lit("general").alias("key"), F.col("fact").alias("text"))
    return graph.migrate(rows, known)


@query("g14_facts", f"SELECT text FROM {_OBS} WHERE contains(text, 'seg')")
def g14(t):
    return graph.observations(_calls(t)).where(F.col("text").contains("seg")).select("text")


# Skills: parts are skills, conversation turns are requests

_SKILLS = "(SELECT p_partkey AS pos, p_name AS name, list_distinct([lower(p_brand), split_part(lower(p_type), ' ', 1), 'the', 'k' || (p_partkey % 40)]) AS kw FROM part)"


@query("l01_tokenise", r"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM conversations")
def l01(t):
    return t("conversations").select("conv_id", "turn", F.size(X.words(F.col("text"))).cast("long").alias("n"))


_NAMES = "array('the', 'and', 'that', 'is', 'ou', 'de', 'la', 'und', 'que', 'el')"


@query("l02_match", """
WITH k AS (SELECT n_nationkey AS pos, n_name AS name, list_distinct([kw[n_nationkey % 10 + 1], kw[(n_nationkey * 3) % 10 + 1], kw[(n_nationkey * 7) % 10 + 1]]) AS kw FROM nation, (SELECT ['the', 'and', 'that', 'is', 'ou', 'de', 'la', 'und', 'que', 'el'] AS kw)),
r AS (SELECT conv_id * 100 + turn AS id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations)
SELECT id, name AS skill, len(list_intersect(w, kw)) AS score FROM r, k WHERE len(list_intersect(w, kw)) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(list_intersect(w, kw)) DESC, pos) = 1""")
def l02(t):
    pick = lambda m: F.expr(f"{_NAMES}[(n_nationkey * {m}) % 10]")
    known = t("nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.array(pick(1), pick(3), pick(7)).alias("keywords"))
    return skills.match(t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), known, "id", "text")


@query("l03_skill_upsert", "SELECT p_brand AS name, p_partkey AS pos FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1")
def l03(t):
    return sync.last_wins(t("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("pos")), "name", F.col("pos"))


_STOPS = ", ".join(f"'{w}'" for w in skills.STOP_WORDS)
_KEY = rf"substr(array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower({{0}}), '[\p{{{{L}}}}\p{{{{N}}}}_]+')), lambda w: w NOT IN ({_STOPS}))), ' '), 1, 80)"


@query("l04_request_key", "SELECT conv_id, turn, " + _KEY.format("text").replace("{{", "{").replace("}}", "}") + " AS key FROM conversations")
def l04(t):
    return t("conversations").select("conv_id", "turn", skills.request_key(F.col("text")).alias("key"))


_REQ = "concat('Please sort the ', event_type, ' of my ', cast(user_id % 30 AS {0}), ' files')"


@query("l05_suggestions", "SELECT key, n, array_to_string(string_split(key, ' ')[1:8], ',') AS keywords FROM (SELECT " + _KEY.format(_REQ.format("VARCHAR")).replace("{{", "{").replace("}}", "}") + " AS key, count(*) AS n FROM events GROUP BY 1) WHERE n >= 2 AND key NOT LIKE '%view%'")
def l05(t):
    rows = t("events").select(F.expr(_REQ.format("STRING")).alias("text"))
    known = rows.select(skills.request_key(F.col("text")).alias("key")).where("key like '%view%'")
    return skills.suggestions(rows, "text", known).select("key", "n", F.array_join("keywords", ",").alias("keywords"))


@query("l06_slug", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || '!'), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def l06(t):
    return t("part").select("p_partkey", skills.slug(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug"))


_QW = "['steel', 'brand', 'part', 'small', 'tin']"
_NW = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query("l07_index_search", f"""
SELECT name, score FROM (SELECT p_name AS name, 3 * len(list_intersect({_QW}, {_NW.format('p_name')})) + 2 * len(list_intersect({_QW}, {_NW.format('p_type')})) + 2 * len(list_intersect({_QW}, {_NW.format('p_brand')}))
  + len(list_filter({_QW}, lambda q: contains(lower(p_type || ' ' || p_brand), q))) AS score FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name)) WHERE score > 0 ORDER BY score DESC, name LIMIT 5""")
def l07(t):
    once = t("part").groupBy("p_name").agg(F.min_by("p_type", "p_partkey").alias("p_type"), F.min_by("p_brand", "p_partkey").alias("p_brand"))
    rows = once.select(F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("description"), X.words(F.col("p_type")).alias("keywords"), X.words(F.col("p_brand")).alias("tags"))
    return skills.index_search(rows, "Steel brand PART small tin").select("name", F.col("score").cast("long").alias("score"))


_MD = "concat('---\nname: ', n_name, '\ndescription: \"About ', n_name, '\"\ntags: [a', n_nationkey, ', \"b c\"， d]\nmetadata:\n  version: 1\n---\n# T\n## When to use\nUse it ', n_nationkey, '.\nMore.\n## Examples\nOne\n')"


@query("l09_frontmatter", "SELECT n_name AS name, 'About ' || n_name AS description, 'a' || n_nationkey || '|b c|d' AS tags FROM nation")
def l09(t):
    rows = t("nation").select(skills.frontmatter(F.expr(_MD.replace("\n", "\\n"))).alias("m"))
    return rows.select("m.name", "m.description", F.array_join("m.tags", "|").alias("tags"))


@query("l10_section", "SELECT n_nationkey, 'Use it ' || n_nationkey || '.' || chr(10) || 'More.' AS body FROM nation")
def l10(t):
    return t("nation").select("n_nationkey", skills.section(F.expr(_MD.replace("\n", "\\n")), "when to use").alias("body"))


@query("l11_combined", "SELECT doc_id, md5(substr(concat_ws(chr(10), source, nullif('', ''), substr(text, 1, 2000), substr(text, 1, 3000), lang), 1, 6000)) AS h FROM documents WHERE text <> ''")
def l11(t):
    rows = t("documents").where("text <> ''")
    return rows.select("doc_id", F.md5(skills.combined(F.col("source"), F.array().cast("array<string>"), F.col("text"), F.col("text"), F.col("lang"))).alias("h"))


_SECOND = "(SELECT embedding AS q2 FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 1)"
_TWO = f"""
a AS (SELECT vec_id, greatest(0, {_DOT.format('embedding', 'q')}) AS sa FROM embeddings, {_FIRST} ORDER BY sa DESC, vec_id LIMIT 30),
b AS (SELECT vec_id, greatest(0, {_DOT.format('embedding', 'q2')}) AS sb FROM embeddings, {_SECOND} ORDER BY sb DESC, vec_id LIMIT 30),
f AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN 0.6 * sa + 0.4 * sb ELSE coalesce(sa, sb) END AS score FROM a FULL JOIN b ON a.vec_id = b.vec_id ORDER BY score DESC, vec_id LIMIT 30)"""


@query("l12_two_channels", f"WITH {_TWO} SELECT vec_id, round(score, 4) AS score FROM f")
def l12(t):
    e = t("embeddings")
    return skills.two_channels(e, _query_vector(e), 30, "vec_id", "embedding", "embedding", _query_vector(e, 1)).select("vec_id", F.round("score", 4).alias("score"))


@query("l13_skill_bm25", retrieve.bm25_sql("part", "p_partkey", "p_type || ' ' || p_name", ["steel", "small", "part"], 3))
def l13(t):
    rows = t("part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return retrieve.bm25(rows, ["steel", "small", "part"], "p_partkey").select("p_partkey", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(3)


@query("l14_retrieve", f"WITH {_TWO}, x AS (SELECT vec_id FROM embeddings WHERE label = 3), u AS (SELECT vec_id, score FROM f UNION ALL SELECT vec_id, greatest(0, {_DOT.format('embedding', 'q')}) FROM embeddings, {_FIRST} WHERE label = 3 AND vec_id NOT IN (SELECT vec_id FROM f)) SELECT vec_id, round(score, 4) AS score FROM u WHERE score >= 0.2")
def l14(t):
    e = t("embeddings")
    q = _query_vector(e)
    found = skills.two_channels(e, q, 30, "vec_id", "embedding", "embedding", _query_vector(e, 1))
    rows = skills.retrieve(e, found, e.where("label = 3").select("vec_id"), q, "vec_id", "embedding", 0.2)
    return rows.select("vec_id", F.round("score", 4).alias("score"))


# Conversations

_TOK = X.agent_tokens_sql("text")


@query("h01_h02_totals", f"SELECT conv_id, sum(4 + {_TOK})::BIGINT AS tokens, sum(4 + {_TOK}) > 1800 AS shrink FROM conversations GROUP BY conv_id")
def h01(t):
    return H.totals(t("conversations"), limit=2000)


_ROLED = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'tool' ELSE role END AS role, text FROM conversations)"


def _roled(t):
    return t("conversations").withColumn("role", F.when(F.col("turn") % 3 == 1, "tool").otherwise(F.col("role")))


@query("h03_trim", f"SELECT conv_id, turn, role FROM (SELECT *, min(CASE WHEN role <> 'tool' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM {_ROLED}) WHERE b <= 3) WHERE turn >= f")
def h03(t):
    return H.trim(_roled(t), 3).select("conv_id", "turn", "role")


_SHRINK = f"(SELECT *, n > 4 AND turn < coalesce(max(CASE WHEN b >= 2 AND role <> 'tool' THEN turn END) OVER (PARTITION BY conv_id), 0) AS old FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM {_ROLED}))"


@query("h04_h05_shrink", f"SELECT conv_id, turn, role, md5(text) AS h FROM {_SHRINK} WHERE NOT old UNION ALL SELECT conv_id, -1, 'system', md5(coalesce(string_agg(CASE WHEN role = 'user' THEN substr(text, 1, 200) END, ' | ' ORDER BY turn), '')) FROM {_SHRINK} WHERE old GROUP BY conv_id")
def h04(t):
    return H.shrink(_roled(t), 2).select("conv_id", "turn", "role", F.md5("text").alias("h"))


@query("h06_transcript", "SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS h FROM (SELECT conv_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || role || ': ' || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...[truncated]' ELSE text END AS line FROM conversations) GROUP BY conv_id")
def h06(t):
    return H.transcript(t("conversations"), 300).select("conv_id", F.md5("transcript").alias("h"))


@query("h07_recent", "SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER w AS lu, max(CASE WHEN role = 'assistant' THEN turn END) OVER w AS la FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role IN ('user', 'assistant') AND text <> '') WHERE b <= 6 WINDOW w AS (PARTITION BY conv_id)) QUALIFY max(CASE WHEN turn = lu AND role = 'user' THEN length(text) END) OVER (PARTITION BY conv_id) >= 150 AND max(CASE WHEN turn = la AND role = 'assistant' THEN length(text) END) OVER (PARTITION BY conv_id) >= 150")
def h07(t):
    return H.recent(t("conversations"), least=150).select("conv_id", "turn", "role")


@query("h08_daily_facts", "SELECT CAST(day AS VARCHAR) AS day, array_to_string(list(f ORDER BY ts, f), ',') AS facts FROM (SELECT ts::DATE AS day, event_type || (user_id % 9) AS f, min(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY day")
def h08(t):
    rows = t("events").select("ts", F.concat("event_type", (F.col("user_id") % 9).cast("string")).alias("fact"))
    return H.daily_facts(rows).select(F.col("day").cast("string").alias("day"), F.array_join("facts", ",").alias("facts"))


@query("h09_stream_fold", """SELECT conv_id AS stream_id, string_agg(replace(text, chr(10), ' '), '' ORDER BY turn) AS content, max(CASE WHEN turn % 2 = 1 THEN turn END)::INT AS total_tokens FROM conversations GROUP BY conv_id HAVING count(*) > 1""")
def h09(t):
    usage = F.when(F.col("turn") % 2 == 1, F.struct(F.col("turn").cast("int").alias("total_tokens")))
    body = F.struct(F.array(F.struct(F.struct(F.replace("text", F.lit("\n"), F.lit(" ")).alias("content")).alias("delta"))).alias("choices"), usage.alias("usage"))
    rows = t("conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), F.to_json(body)).alias("line"))
    extra = rows.select("stream_id", F.explode(F.array(F.struct(F.lit(1000).cast("long").alias("seq"), F.lit("data: [DONE]").alias("line")), F.struct(F.lit(2000).cast("long").alias("seq"), F.lit("data: {\"choices\": [{\"delta\": {\"content\": \"late\"}}]}").alias("line")), F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("data: {broken").alias("line")))).alias("e")).distinct()
    many = t("conversations").groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("stream_id"))
    return H.fold_stream(rows.unionByName(extra.select("stream_id", "e.seq", "e.line")).join(many, "stream_id", "left_semi")).select("stream_id", "content", "total_tokens")


@query("h11_too_long", "SELECT event_id, event_type IN ('click', 'view') AS too_long FROM events")
def h11(t):
    message = F.when(F.col("event_type") == "click", "400: Maximum context of 8192").when(F.col("event_type") == "view", "Too many TOKENS here").otherwise("500: overloaded")
    return t("events").select("event_id", H.is_too_long(message).alias("too_long"))


@query("h14_command_label", "SELECT event_id, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' ELSE 'run ' || event_type END AS label FROM events")
def h14(t):
    return t("events").select("event_id", H.command_label(F.concat(F.lit(" "), "event_type", F.lit(" -x 1")), {"click": "press", "view": "look"}).alias("label"))


_DEPS = ", ".join(f"('{e}', '{m}', '{p}', {str(r).lower()})" for e, ds in sorted(deps.FORMATS.items()) for m, p, r in ds)
_COREV = ", ".join(f"('{m}', '{p}', true)" for m, p in deps.CORE)


@query("x01_format_table", f"SELECT * FROM (VALUES {_DEPS}) v(ext, import_name, pip_spec, required)")
def x01(t):
    return deps.formats_table(t("nation").sparkSession)


@query("x02_dependencies", f"SELECT pip_spec, min(import_name) AS import_name, bool_or(required) AS required FROM (SELECT * FROM (VALUES {_COREV}) v(import_name, pip_spec, required) UNION ALL SELECT import_name, pip_spec, required FROM (VALUES {_DEPS}) v(ext, import_name, pip_spec, required) WHERE ext IN (SELECT CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'html' END FROM documents)) GROUP BY pip_spec")
def x02(t):
    rows = t("documents").select(F.expr("concat('a/b.', CASE doc_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' ELSE 'html' END)").alias("path"))
    return deps.required(rows)


@query("k06_flagship_slice", None)
def slice_(t):
    """Paragraph chunks, their embeddings and a vector search over them in one plan."""
    embed = V.Md5Embedding(1)
    rows = K.chunk_documents(t("documents").select(F.col("doc_id").cast("string").alias("source"), "text"), K.split_paragraphs(F.col("text")))
    return retrieve.vector_search(rows.withColumn("vector", V.normalize(embed.documents(F.col("text")))), [0.25] * 16, 10)
