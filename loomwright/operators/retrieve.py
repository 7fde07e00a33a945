"""Retrieval: vector top-k, BM25 on postings, ordered merge, re-scoring, formatted context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, words
from ..functions.vectors import literal, similarity

K1, B = 1.2, 0.75
OVERFETCH, CUT = 4, 0.7


def vector_search(chunks: DataFrame, query: list[float], k: int = 5, vector: str = "vector", where: Column | None = None, keys: tuple[str, ...] = ("source", "chunk_index")) -> DataFrame:
    """The k most similar rows; the query is a literal, so this is a projection under a top-k and shuffles nothing else."""
    rows = chunks if where is None else chunks.where(where)
    return rows.withColumn("score", similarity(F.col(vector), literal(query))).orderBy(F.desc("score"), *keys).limit(k)


def postings(chunks: DataFrame, key: str, text: str = "text", tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(term, key, tf, dl)."""
    tokens = chunks.select(F.col(key), tokenize(F.col(text)).alias("t"))
    return tokens.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def statistics(chunks: DataFrame, text: str = "text", tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """One row: number of rows and their mean length in terms."""
    return chunks.select(F.size(tokenize(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def bm25(chunks: DataFrame, terms: list[str], key: str, text: str = "text", tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(key, score) of every row that has a term of the query.

    With a literal query no postings are shuffled: term counts are taken by row,
    document frequencies and lengths in the one aggregate beside them.
    """
    terms = sorted(set(terms))
    if not terms:
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = chunks.select(F.col(key), tokenize(F.col(text)).alias("t"))
    tf = [F.size(F.filter("t", _is(q))) for q in terms]
    rows = rows.select(key, F.size("t").alias("dl"), F.array(*tf).alias("tf"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col("tf")[k] > 0).cast("int")).alias(f"df{k}") for k in range(len(terms))])
    hit = rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        f = F.col("tf")[k]
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.select(key, score.alias("score"))


def counts(terms: Column) -> Column:
    """(term, tf) of each term of an array, by the runs of the sorted array."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("i"))), lambda p: (p["i"] == 0) | (F.get(s, p["i"] - 1) != p["term"]))
        end = lambda a, k: F.coalesce(F.get(a, k + 1)["i"], F.size(s))
        return let(first, lambda a: F.transform(a, lambda p, k: F.struct(p["term"].alias("term"), (end(a, k) - p["i"]).cast("long").alias("tf"))))

    return let(F.sort_array(terms), runs)


def indexed_postings(chunks: DataFrame, key: str = "id", text: str = "text", source: str = "source", tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(term, id, source, tf, dl) as they are stored; sorted by term, a search reads the row groups of its terms.

    Terms are counted in their row, so nothing is shuffled; rows of one id are added up by the search.
    """
    tokens = chunks.select(F.col(key).cast("string").alias("id"), F.col(source).alias("source"), tokenize(F.col(text)).alias("t"))
    counted = tokens.select("id", "source", F.size("t").cast("long").alias("dl"), F.inline(counts(F.col("t"))))
    return counted.select("term", "id", "source", "tf", "dl")


def indexed_lengths(chunks: DataFrame, text: str = "text", source: str = "source", tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(source, n, dl): rows and terms of each source."""
    return chunks.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.sum(F.size(tokenize(F.col(text)))).cast("long").alias("dl"))


def bm25_indexed(postings: DataFrame, lengths: DataFrame, terms: list[str], where: Column | None = None) -> DataFrame:
    """R04 from the stored index: (id, score); ``where`` is a condition on ``source``."""
    if where is not None:
        postings, lengths = postings.where(where), lengths.where(where)
    hits = postings.where(F.col("term").isin(*sorted(set(terms)))) if terms else postings.limit(0)
    hits = hits.groupBy("id", "term", "source", "dl").agg(F.sum("tf").alias("tf"))
    total = lengths.agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))  # a row for each term of the query, one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(score).alias("score"))


def bm25_sql(table: str, key: str, text: str, terms: list[str], limit: int | None = None) -> str:
    """R04 in DuckDB, from postings."""
    listed = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    top = f" ORDER BY score DESC, {key} LIMIT {limit}" if limit else ""
    return rf"""
WITH t AS (SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+') AS w FROM {table}),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT {key}, len(w) AS dl, term, count(*) AS tf FROM (SELECT {key}, w, unnest(w) AS term FROM t) WHERE term IN ({listed}) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 4) AS score
FROM p JOIN d USING (term), s GROUP BY {key}{top}"""


def merge(vector_hits: DataFrame, text_hits: DataFrame, keys: list[str]) -> DataFrame:
    """Vector hits first, then text hits; of equal keys the first stays.  Both inputs are top-k lists, so one task holds them."""
    order = Window.orderBy(F.desc("score"), *keys)
    a = vector_hits.select(*keys, "score").withColumns({"channel": F.lit(0), "place": F.row_number().over(order)})
    b = text_hits.select(*keys, "score").withColumns({"channel": F.lit(1), "place": F.row_number().over(order)})
    both = a.unionByName(b).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("channel", "place"))).where("_n = 1").drop("_n")
    return both.withColumn("merged", F.row_number().over(Window.orderBy("channel", "place")))


def rescore(s: Column, mode: str = "reference") -> Column:
    """R07's score: above 1 (a raw text score) it is rewritten; ``sane`` maps such scores to 1 - 1/(1+s) instead, which keeps their order."""
    high = F.greatest(F.lit(0.0), 1 - s * s / 2) if mode == "reference" else 1 - 1 / (1 + s)
    return F.when(s > 1, high).otherwise(s)


def rerank_fallback(candidates: DataFrame, k: int = 3, mode: str = "reference") -> DataFrame:
    """R07."""
    return candidates.withColumn("rerank_score", rescore(F.col("score"), mode)).orderBy(F.desc("rerank_score"), "merged").limit(k)


def rerank(candidates: DataFrame, score: Column, k: int = 3, least: float = CUT) -> DataFrame:
    """By a scorer's column (a sigmoid), top k, and only then the cut."""
    return candidates.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), "merged").limit(k).where(F.col("rerank_score") >= least)


def rerank_or_fallback(candidates: DataFrame, score: Column, k: int = 3, least: float = CUT, mode: str = "reference") -> DataFrame:
    """R06, and R07 where the scorer failed (null) or leaves nothing.  Candidates are a top-k list, so one task holds them."""
    rows = candidates.withColumn("_s", score)
    rows = rows.withColumn("_r", F.row_number().over(Window.orderBy(F.desc_nulls_last("_s"), "merged")))
    rows = rows.withColumn("_ok", F.coalesce((F.col("_r") <= k) & (F.col("_s") >= least), F.lit(False)))
    rows = rows.withColumn("_any", F.max("_ok").over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("rerank_score", F.when(F.col("_any"), F.col("_s")).otherwise(rescore(F.col("score"), mode)))
    return rows.where(F.col("_ok") | ~F.col("_any")).drop("_s", "_r", "_ok", "_any").orderBy(F.desc("rerank_score"), "merged").limit(k)


def at_least(rows: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Nothing is dropped where ``least`` is 0 or below."""
    return rows if least <= 0 else rows.where(F.col(score) >= least)


def hybrid_search(chunks: DataFrame, query: list[float], terms: list[str], k: int = 3, key: str = "chunk_id", vector: str = "vector", text: str = "text", where: Column | None = None, mode: str = "reference") -> DataFrame:
    """R09 without a cross-encoder: both channels k x 4, merged, re-scored, top k."""
    rows = chunks if where is None else chunks.where(where)
    a = vector_search(rows, query, k * OVERFETCH, vector, keys=(key,)).select(key, "score")
    b = bm25(rows, terms, key, text).orderBy(F.desc("score"), key).limit(k * OVERFETCH)
    return rerank_fallback(merge(a, b, [key]), k, mode)


def formatted(hits: DataFrame, order: list[Column], per_hit: int = 1500, total: int = 8000, text: str = "text", source: str = "source") -> DataFrame:
    """One text a hit, cut with an ellipsis, until the texts before it reach ``total``; the one that crosses is kept."""
    w = Window.orderBy(*order)
    short = F.when(F.length(text) > per_hit, F.concat(F.substring(text, 1, per_hit), F.lit("…"))).otherwise(F.col(text))
    rows = hits.withColumn("place", F.row_number().over(w)).withColumn("entry", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col(source), F.lit("\n"), short))
    before = F.coalesce(F.sum(F.length("entry")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < total).select("place", "entry")


def status(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Number of chunks and of sources, and whether there is anything."""
    named = F.when(F.col(source) != "", F.col(source))
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct(named).alias("sources")).withColumn("has_kb", F.col("chunks") > 0)


def sources(chunks: DataFrame, source: str = "source") -> DataFrame:
    return chunks.where(F.col(source).isNotNull() & (F.col(source) != "")).select(source).distinct().orderBy(source)
