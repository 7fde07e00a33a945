"""Sources: directories of documents, skills, JSON state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.deps import extension
from ..operators.skills import frontmatter
from .parsers import SUFFIXES, parse_column


def hidden(path: Column) -> Column:
    """Whether a part of the path below the root begins with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def files(spark: SparkSession, root: str, recursive: bool = True, suffixes: list[str] | None = None) -> DataFrame:
    """(source, suffix, mtime, size, content); what a query doesn't select is not read, the content included.

    Files of no bytes are not listed: Spark's reader passes over them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in base) + "/", "")
    rows = raw.select(rel.alias("source"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.withColumn("suffix", extension(F.col("source"))).where(F.col("suffix").isin(*(suffixes or SUFFIXES)) & ~hidden(F.col("source")))


def counts(rows: DataFrame) -> DataFrame:
    """S02."""
    return rows.groupBy("suffix").agg(F.count("*").alias("n"))


def extensions(rows: DataFrame, path: str = "source") -> DataFrame:
    """S18."""
    return rows.select(extension(F.col(path)).alias("ext")).where("ext is not null").distinct()


def documents(rows: DataFrame) -> DataFrame:
    """(source, mtime, size, text, status, error) with the text cleaned unless it is Markdown."""
    parsed = rows.withColumn("p", parse_column(F.col("content"), F.col("suffix")))
    text = F.when(F.col("p.is_markdown"), F.col("p.text")).otherwise(X.normalize_markdown(X.clean_text(F.col("p.text"))))
    status = F.when(F.col("p.error").isNull(), "ok").otherwise("error")
    return parsed.select("source", "mtime", "size", text.alias("text"), status.alias("status"), F.col("p.error").alias("error"))


SKIP_DIRS = r"(^|/)(tests?|__pycache__|cache|node_modules|\.[^/]*)(/|$)"


def skill_files(spark: SparkSession, root: str) -> DataFrame:
    """Every SKILL.md but those in test, cache and hidden directories, with its front matter."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    text = F.decode("content", "UTF-8")
    rows = raw.select(F.regexp_replace(rel, r"/?SKILL\.md$", "").alias("dir"), text.alias("text")).where(~F.col("dir").rlike(SKIP_DIRS))
    return rows.withColumn("meta", frontmatter(F.col("text"))).select("dir", "meta.name", "meta.description", "meta.tags", "text", F.md5("text").alias("fingerprint"))


SKILL_JSON = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("entry", T.StringType()),
])


def skill_index(spark: SparkSession, root: str) -> DataFrame:
    """Skill.json one level down; needs a name and its entry file, prompt.md by default."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    rows = raw.select(rel.alias("rel"), "content").where(F.col("rel").rlike(r"^[^/_.][^/]*/[^/]+$"))
    there = rows.select(F.col("rel").alias("file"))
    meta = rows.where(F.col("rel").endswith("/skill.json")).select(F.substring_index("rel", "/", 1).alias("path"), F.from_json(F.decode("content", "UTF-8"), SKILL_JSON).alias("j"))
    meta = meta.select("path", "j.name", F.coalesce("j.description", F.lit("")).alias("description"), "j.keywords", "j.tags", F.coalesce("j.entry", F.lit("prompt.md")).alias("entry")).where("name <> ''")
    return meta.withColumn("file", F.concat_ws("/", "path", "entry")).join(there, "file", "left_semi").drop("file")


def state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON state file; missing or broken ones are empty."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except Exception:
        return spark.createDataFrame([], schema)
    return rows.select(F.from_json("value", schema).alias("j")).where("j is not null").select("j.*")


def web_text(html: Column) -> Column:
    """S19 on stored pages: no scripts, no styles, no tags; trimmed lines, 20 000 characters."""
    return X.web_text(X.apply_rule(X.apply_rule(html, "c01"), "c03"))
