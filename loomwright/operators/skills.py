"""Skills: keyword match, request counters, weighted index search, hybrid retrieval, SKILL.md parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words
from ..functions.vectors import literal, similarity

STOP_WORDS = "this that these those the a an and or of in on at to for from by with as is are was were be been do does did i we you it me my our please".split()
CUT, DESC, EXAMPLES = 0.5, 0.6, 0.4


def match(requests: DataFrame, skills: DataFrame, key: str, text: str) -> DataFrame:
    """The skill with most keywords among the request's words; the earlier skill wins ties; none without a hit.

    ``skills`` (name, keywords, pos) is a registry, checked and broadcast by the optimizer's threshold.
    """
    rows = requests.select(F.col(key), F.array_distinct(words(F.col(text))).alias("t"))
    hits = rows.select(key, F.explode("t").alias("w")).join(skills.select("name", "pos", F.explode(F.array_distinct("keywords")).alias("w")), "w")
    scored = hits.groupBy(key, "name", "pos").agg(F.count("*").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col("name").alias("skill"), "score")


def request_key(text: Column) -> Column:
    """Sorted distinct words but stop words, 80 characters."""
    kept = F.filter(F.array_distinct(words(text)), lambda w: ~w.isin(*STOP_WORDS))
    return F.substring(F.array_join(F.array_sort(kept), " "), 1, 80)


def suggestions(requests: DataFrame, text: str, known: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Keys asked for ``least`` times or more that no skill serves, with up to 8 keywords."""
    counted = requests.select(request_key(F.col(text)).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if known is not None:
        counted = counted.join(known.select("key").distinct(), "key", "left_anti")
    return counted.withColumn("keywords", F.slice(F.split("key", " "), 1, 8))


def slug(name: Column) -> Column:
    """L06."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(name)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def index_search(skills: DataFrame, query: str, k: int = 5) -> DataFrame:
    """3 a word in the name, 2 a keyword, 2 a tag, 1 a word within the description."""
    terms = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    q = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    lower = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower))
    size = lambda c: F.size(F.array_intersect(q, c))
    score = 3 * size(words(F.col("name"))) + 2 * size(lower(F.col("keywords"))) + 2 * size(lower(F.col("tags"))) + F.size(F.filter(q, lambda t: F.contains(F.lower("description"), t)))
    return skills.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "name").limit(k)


def frontmatter(text: Column) -> Column:
    """(name, description, tags) of the block between the leading dashes."""
    block = F.regexp_extract(text, r"^---([\s\S]*?)\n---", 1)

    def field(name: str) -> Column:
        raw = strip(F.regexp_extract(block, rf"(?m)^\s*{name}\s*:[ \t]*(.*)$", 1))
        return F.when(raw.rlike("^\"[\\s\\S]*\"$|^'[\\s\\S]*'$"), F.substring(raw, 2, 1 << 20).substr(F.lit(1), F.length(raw) - 2)).otherwise(raw)

    tags = F.regexp_replace(field("tags"), r"^\[|\]$", "")
    items = F.filter(F.transform(F.split(tags, "[,，]"), lambda t: F.regexp_replace(strip(t), "^[\"']+|[\"']+$", "")), lambda t: t != "")
    return F.struct(field("name").alias("name"), field("description").alias("description"), items.alias("tags"))


def section(text: Column, heading: str) -> Column:
    """The body below the first second-level heading of that title."""
    return strip(F.regexp_extract(text, rf"(?i)(?:^|\n)\s*## \s*{heading}\s*\n([\s\S]*?)(?=\n\s*## |$)", 1))


def combined(name: Column, tags: Column, description: Column, when: Column, examples: Column) -> Column:
    """The text that is indexed, each part and the whole cut."""
    part = lambda c, n: F.when(F.coalesce(c, F.lit("")) != "", F.substring(c, 1, n))
    return F.substring(F.concat_ws("\n", part(name, 1 << 20), part(F.array_join(tags, " "), 1 << 20), part(description, 2000), part(when, 3000), part(examples, 3000)), 1, 6000)


def two_channels(skills: DataFrame, query: list[float], k: int = 3, key: str = "dir", a: str = "desc_vec", b: str = "examples_vec", second: list[float] | None = None) -> DataFrame:
    """Top k by either vector; in both: 0.6 and 0.4 of the scores, in one: that score as it is."""
    top = lambda v, q, name: skills.select(key, similarity(F.col(v), literal(q)).alias(name)).orderBy(F.desc(name), key).limit(k)
    both = top(a, query, "sa").join(top(b, second or query, "sb"), key, "full_outer")
    score = F.when(F.col("sa").isNotNull() & F.col("sb").isNotNull(), DESC * F.col("sa") + EXAMPLES * F.col("sb")).otherwise(F.coalesce("sa", "sb"))
    return both.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def retrieve(skills: DataFrame, by_vector: DataFrame, by_text: DataFrame, query: list[float], key: str = "dir", vector: str = "desc_vec", least: float = CUT) -> DataFrame:
    """Both lists by key; rows found by text alone get their description's similarity; cut, then order."""
    only = by_text.join(by_vector, key, "left_anti").select(key)
    looked = skills.join(only, key, "left_semi").select(key, similarity(F.col(vector), literal(query)).alias("score"))
    return by_vector.select(key, "score").unionByName(looked).where(F.col("score") >= least).orderBy(F.desc("score"), key)
