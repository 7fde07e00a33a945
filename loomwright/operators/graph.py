"""Knowledge-graph memory: entities, observations, relations, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import literal, similarity
from ..schemas import EXTRACTION


def key_of(name: Column) -> Column:
    return F.lower(strip(name))


def upsert_entities(calls: DataFrame, order: str = "seq") -> DataFrame:
    """One entity a key from create calls (name, type, observations, seq).

    The first spelling and the first non-empty type stay; observations are
    stripped, blanks dropped, of equal ones the first stays.
    """
    rows = calls.where(strip(F.col("name")) != "").withColumn("key", key_of(F.col("name")))
    heads = rows.groupBy("key").agg(
        F.min_by("name", order).alias("name"),
        F.min_by(F.when(F.col("type") != "", F.col("type")), F.when(F.col("type") != "", F.col(order))).alias("type"),
        *([F.min("created_at").alias("created_at")] if "created_at" in calls.columns else []),
    )
    return heads


def observations(calls: DataFrame, order: str = "seq") -> DataFrame:
    """(key, ord, text), exact repeats dropped, in order of arrival."""
    rows = calls.select(key_of(F.col("name")).alias("key"), F.col(order), F.posexplode("observations").alias("pos", "raw")).withColumn("text", strip(F.col("raw"))).where("text <> ''")
    first = rows.groupBy("key", "text").agg(F.min(F.struct(order, "pos")).alias("at"))
    return first.select("key", F.row_number().over(Window.partitionBy("key").orderBy("at")).cast("long").alias("ord"), "text")


def new_observations(known: DataFrame, calls: DataFrame, order: str = "seq") -> DataFrame:
    """What a batch adds; its count is the number added."""
    return observations(calls, order).join(known.select("key", "text"), ["key", "text"], "left_anti")


def relations(calls: DataFrame, order: str = "seq") -> DataFrame:
    """Directed labelled edges; blank parts are refused, of equal ones (any case) the first spelling stays."""
    cols = ["source", "target", "label"]
    rows = calls.select(order, *[strip(F.col(c)).alias(c) for c in cols]).where(" and ".join(f"{c} <> ''" for c in cols))
    w = Window.partitionBy(*[F.lower(c) for c in cols]).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*cols, order)


def endpoints(edges: DataFrame) -> DataFrame:
    """The entities that edges create."""
    return edges.select(F.explode(F.array("source", "target")).alias("name")).select(key_of(F.col("name")).alias("key"), "name").groupBy("key").agg(F.min("name").alias("name"))


def delete_entities(entities: DataFrame, edges: DataFrame, obs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with their edges and observations, all by lower-case key."""
    keys = gone.select(key_of(F.col("name")).alias("key")).distinct()
    left = entities.join(keys, "key", "left_anti")
    kept = edges.join(keys.withColumnRenamed("key", "_k"), key_of(F.col("source")) == F.col("_k"), "left_anti")
    kept = kept.join(keys.withColumnRenamed("key", "_k"), key_of(F.col("target")) == F.col("_k"), "left_anti")
    return left, kept, obs.join(keys, "key", "left_anti")


def observation_id(entity: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat(entity, F.lit("|"), text)), 1, 16)


def backfill(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(id, entity, text) that the index lacks."""
    rows = pairs.select(observation_id(F.col("entity"), F.col("text")).alias("id"), "entity", "text").dropDuplicates(["id"])
    return rows.join(index.select("id"), "id", "left_anti")


def semantic_search(index: DataFrame, query: list[float], k: int = 8, least: float = 0.5, vector: str = "vector", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Top k, then what reaches ``least``, rounded to 4 places."""
    top = index.withColumn("score", similarity(F.col(vector), literal(query))).orderBy(F.desc("score"), *keys).limit(k)
    return top.where(F.col("score") >= least).withColumn("score", F.round("score", 4))


def keyword_search(obs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Substring in any case, constant score."""
    return obs.where(F.contains(F.lower(text), F.lower(F.lit(query)))).withColumn("score", F.lit(0.5))


def snapshot(obs: DataFrame, most: int = 10) -> DataFrame:
    """Entities with most observations first (ties by key), their first three joined."""
    grouped = obs.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.array_agg(F.struct("ord", "text"))).alias("o"))
    top = grouped.orderBy(F.desc("n"), "key").limit(most)
    return top.select("key", "n", F.array_join(F.transform(F.slice("o", 1, 3), lambda x: x["text"]), "; ").alias("summary"))


def snapshot_lines(entities: DataFrame, obs: DataFrame, edges: DataFrame, most: int = 10, order: str = "seq") -> DataFrame:
    """G10 whole: (kind, place, line): entities with their types first, then the first half as many relations."""
    top = snapshot(obs, most).join(entities.select("key", "name", "type"), "key", "left")
    kind = F.when(F.coalesce("type", F.lit("")) != "", F.concat(F.lit(" ("), "type", F.lit(")"))).otherwise("")
    a = top.select(F.lit(0).alias("kind"), F.row_number().over(Window.orderBy(F.desc("n"), "key")).alias("place"), F.concat(F.lit("- "), F.coalesce("name", "key"), kind, F.lit(": "), "summary").alias("line"))
    first = edges.orderBy(order).limit(most // 2)
    b = first.select(F.lit(1).alias("kind"), F.row_number().over(Window.orderBy(order)).alias("place"), F.concat(F.lit("- "), "source", F.lit(" --["), "label", F.lit("]--> "), "target").alias("line"))
    return a.unionByName(b)


def parse_extraction(reply: Column) -> Column:
    """A model's reply, fenced or bare, as a graph; anything else is an empty one."""
    body = F.regexp_extract(reply, r"(\{[\s\S]*\})", 1)
    return F.from_json(body, EXTRACTION)


def apply_extraction(replies: DataFrame, reply: str, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(entity calls, relation calls) of extracted replies; both keep the order of the replies."""
    g = replies.select(F.col(order), parse_extraction(F.col(reply)).alias("g"))
    ents = g.select(order, F.explode("g.entities").alias("e")).select(order, "e.name", "e.type", F.coalesce("e.observations", F.array().cast("array<string>")).alias("observations"))
    rels = g.select(order, F.explode("g.relations").alias("r")).select(order, "r.source", "r.target", "r.label")
    return ents, rels


def extracted_facts(ents: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, fact) that go to the daily facts too, ``name: observation``."""
    rows = ents.select(order, "name", F.posexplode("observations").alias("pos", "o"))
    return rows.where((strip(F.col("o")) != "") & (strip(F.col("name")) != "")).select(order, F.concat(strip(F.col("name")), F.lit(": "), strip(F.col("o"))).alias("fact"))


def migrate(facts: DataFrame, obs: DataFrame, entity: str = "General") -> DataFrame:
    """Flat facts become observations of one entity, but for those it has."""
    rows = facts.select(F.lit(entity.lower()).alias("key"), strip(F.col("fact")).alias("text")).where("text <> ''").distinct()
    return rows.join(obs.select("key", "text"), ["key", "text"], "left_anti")
