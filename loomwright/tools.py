"""Tool surface: a name and JSON arguments in, (success, output, error) out; errors are values."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.text import words
from .functions.vectors import Provider, normalize
from .operators import graph, retrieve, skills, sync
from .operators.memory import KeyValueStore
from .plans.engine import Engine
from .sinks.tables import VersionedTable
from .sources import scan


@dataclass
class Result:
    """What a tool gave back."""

    success: bool
    output: str = field(default="")
    error: str = field(default="")


def props(**types: str) -> dict[str, Any]:
    """JSON schema of arguments by name and type."""
    return {name: {"type": kind} for name, kind in types.items()}


@dataclass
class Tool:
    name: str
    description: str
    run: Callable[..., str]
    parameters: dict[str, Any] = field(default_factory=dict)

    def schema(self) -> dict[str, Any]:
        inner = dict(name=self.name, description=self.description, parameters=dict(type="object", properties=self.parameters))
        return dict(type="function", function=inner)


class Registry:
    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self.tools.get(name)

    def names(self) -> list[str]:
        return sorted(self.tools)

    def schemas(self) -> list[dict[str, Any]]:
        return [self.tools[n].schema() for n in self.names()]

    def execute(self, name: str, args: str | dict[str, Any] | None = None) -> Result:
        tool = self.tools.get(name)
        if tool is None:
            return Result(False, error=f"unknown tool: {name}")
        try:
            return Result(True, tool.run(**parse_args(args)))
        except Exception as e:
            return Result(False, error=": ".join((type(e).__name__, str(e))))


def parse_args(args: str | dict[str, Any] | None) -> dict[str, Any]:
    """JSON text or a mapping; anything else is no arguments."""
    if isinstance(args, dict):
        return args
    try:
        found = json.loads(args or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def inside(root: str, path: str) -> Path:
    """A path below ``root``, or an error."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if base != full and base not in full.parents:
        raise PermissionError(f"{path} is outside the workspace")
    return full


def retrieval_tools(engine: Engine, registry: Registry) -> None:
    def search(query: str, top_k: int = 3, source: str | None = None) -> str:
        return engine.search_text(query, max(1, min(10, int(top_k))), source) or "nothing found"

    def outline(book_name: str = "") -> str:
        rows = engine.outline(book_name.strip() or None).collect()
        return "\n".join(r["digest"] if book_name.strip() else r["doc_name"] for r in rows) or "no documents"

    registry.register(Tool("rag_search", "Search the knowledge base.", search, props(query="string", top_k="integer", source="string")))
    registry.register(Tool("rag_outline", "Outline of a document, or the list of documents.", outline, props(book_name="string")))
    registry.register(Tool("rag_status", "State of the knowledge base.", lambda: json.dumps(engine.status())))
    registry.register(Tool("rag_ingest", "Read new and changed files.", lambda force=False: json.dumps(engine.ingest(bool(force)), default=str), props(force="boolean")))


def memory_tools(store: KeyValueStore, registry: Registry) -> None:
    def work(op: str, key: str = "", value: Any = None) -> str:
        if op == "set":
            store.set(key, value)
            return "ok"
        if op == "get":
            return json.dumps(store.get(key), ensure_ascii=False)
        if op == "list":
            return json.dumps(store.all(), ensure_ascii=False)
        if op == "clear":
            store.replace({})
            return "ok"
        raise ValueError(f"unknown operation: {op}")

    registry.register(Tool("work_memory", "Short notes.", work, props(op="string", key="string", value="string")))


def table_tools(obs, index, skill_rows, embed: Callable[[str], list[float]], registry: Registry) -> None:
    """Tools over given tables: observations (key, ord, text), their embedded index, and the skill index."""
    text = lambda rows, *cols: "\n".join(" | ".join(str(r[c]) for c in cols) for r in rows.collect()) or "nothing found"

    def recall(query: str, top_k: int = 5) -> str:
        if index is not None:
            return text(graph.semantic_search(index, embed(query), int(top_k)), "entity", "text", "score")
        return text(graph.keyword_search(obs, query), "key", "text", "score")

    def show(op: str = "snapshot", name: str = "") -> str:
        if op == "snapshot":
            return text(graph.snapshot(obs), "key", "summary")
        if op == "get":
            return text(obs.where(F.col("key") == name.strip().lower()).orderBy("ord"), "text")
        if op == "list":
            return text(obs.select("key").distinct().orderBy("key"), "key")
        raise ValueError(f"unknown operation: {op}")

    registry.register(Tool("memory_search", "Search memories.", recall, props(query="string", top_k="integer")))
    registry.register(Tool("memory_graph", "Entities and what is known of them.", show, props(op="string", name="string")))
    registry.register(Tool("skill_search", "Find a skill.", lambda query="", op="search": text(skills.index_search(skill_rows, query) if op == "search" else skill_rows.orderBy("name"), "name", "description"), props(query="string")))


class Graph:
    """G01-G05 over stored tables: one call at a time, as a tool makes it; only the buckets of its keys are rewritten."""

    def __init__(self, spark: SparkSession, state: str):
        self.spark = spark
        self.entities = VersionedTable(spark, f"{state}/entities", schemas.ENTITIES, "key", 4)
        self.observations = VersionedTable(spark, f"{state}/observations", schemas.OBSERVATIONS, "key", 4)
        self.relations = VersionedTable(spark, f"{state}/relations", schemas.RELATIONS, "source", 4)

    def create(self, name: str, kind: str = "", observations: list[str] | None = None) -> int:
        """Number of observations added; an entity that is there keeps its name, and its type where it has one."""
        if not name.strip():
            raise ValueError("an entity needs a name")
        call = self.spark.createDataFrame([(0, name.strip(), kind or "", observations or [])], "seq long, name string, type string, observations array<string>")
        mine = self.entities.read().where(F.col("key") == name.strip().lower())
        new = graph.upsert_entities(call).withColumn("created_at", F.current_timestamp().cast("string"))
        old = mine.select("key", F.col("name").alias("_n"), F.col("type").alias("_t"), F.col("created_at").alias("_c"))
        self.entities.upsert(new.join(old, "key", "left").select("key", F.coalesce("_n", "name").alias("name"), F.coalesce("_t", "type").alias("type"), F.coalesce("_c", "created_at").alias("created_at")), "key")
        known = self.observations.read().where(F.col("key") == name.strip().lower())
        last = known.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
        more = graph.new_observations(known, call).select("key", (F.col("ord") + last).alias("ord"), "text")
        n = more.count()
        if n:
            self.observations.upsert(known.unionByName(more), "key")
        return n

    def relate(self, source: str, target: str, label: str) -> bool:
        """Whether the edge is new; its ends become entities."""
        call = self.spark.createDataFrame([(0, source, target, label)], "seq long, source string, target string, label string")
        edge = graph.relations(call).drop("seq")
        same = [F.lower(F.col(c)) == s.strip().lower() for c, s in (("source", source), ("target", target), ("label", label))]
        known = self.relations.read()
        if edge.isEmpty() or not known.where(same[0] & same[1] & same[2]).isEmpty():
            return False
        for end in (source, target):
            self.create(end)
        first = known.where(F.col("source") == source.strip())
        self.relations.upsert(first.unionByName(edge), "source")
        return True

    def delete(self, name: str) -> bool:
        key = name.strip().lower()
        gone = self.spark.createDataFrame([(key,)], "key string")
        there = not self.entities.read().where(F.col("key") == key).isEmpty()
        self.entities.replace(gone)
        self.observations.replace(gone)
        edges = self.relations.read()
        lost = edges.where((F.lower("source") == key) | (F.lower("target") == key))
        sources = lost.select("source").distinct()
        stay = edges.join(sources, "source", "left_semi").where((F.lower("source") != key) & (F.lower("target") != key))
        if not lost.isEmpty():
            self.relations.replace(sources, stay)
        return there

    def clear(self) -> None:
        for t in (self.entities, self.observations, self.relations):
            t.clear()


def graph_tools(store: Graph, registry: Registry) -> None:
    """``memory_graph`` with all eight operations."""

    def run(op: str, name: str = "", entity_type: str = "", observations: list[str] | None = None, source: str = "", target: str = "", label: str = "") -> str:
        need = {"create_entity": ["name"], "delete_entity": ["name"], "get_entity": ["name"], "add_observations": ["name", "observations"], "create_relation": ["source", "target", "label"]}
        given = {"name": name, "observations": observations, "source": source, "target": target, "label": label}
        if missing := [k for k in need.get(op, []) if not given[k]]:
            raise ValueError(f"{op} needs {', '.join(missing)}")
        key = name.strip().lower()
        if op == "create_entity":
            return json.dumps({"added": store.create(name, entity_type, observations)})
        if op == "add_observations":
            return json.dumps({"added": store.create(name, "", observations)})
        if op == "create_relation":
            return "created" if store.relate(source, target, label) else "duplicate or invalid"
        if op == "delete_entity":
            return "deleted" if store.delete(name) else "not found"
        if op == "get_entity":
            one = store.entities.read().where(F.col("key") == key).first()
            obs = [r["text"] for r in store.observations.read().where(F.col("key") == key).orderBy("ord").collect()]
            return "not found" if one is None else json.dumps({"name": one["name"], "type": one["type"], "observations": obs}, ensure_ascii=False)
        if op == "list_entities":
            counts = store.observations.read().groupBy("key").agg(F.count("*").alias("n"))
            rows = store.entities.read().join(counts, "key", "left").orderBy("key").collect()
            return json.dumps([f"{r['name']} ({r['type'] or '?'}) [{r['n'] or 0}]" for r in rows], ensure_ascii=False)
        if op == "snapshot":
            lines = graph.snapshot_lines(store.entities.read(), store.observations.read(), store.relations.read(), order="source")
            return "\n".join(r["line"] for r in lines.orderBy("kind", "place").collect()) or "(empty)"
        if op == "clear":
            store.clear()
            return "cleared"
        raise ValueError(f"unknown operation: {op}")

    registry.register(Tool("memory_graph", "Entities, observations and relations.", run, props(op="string", name="string", entity_type="string", observations="array", source="string", target="string", label="string")))


class SkillIndex:
    """The stored index of a directory of skills, brought up to date when asked."""

    def __init__(self, spark: SparkSession, root: str, state: str, embed: Provider):
        self.spark, self.root, self.embed = spark, root, embed
        self.table = VersionedTable(spark, f"{state}/skills", schemas.SKILL_INDEX, "dir", 4)

    def ensure(self) -> dict[str, int]:
        """Built where there is none, else only what changed is written; says how many of each change."""
        files = scan.skill_files(self.spark, self.root)
        changes = sync.classify(self.table.read(), files, "dir", "fingerprint").where("change <> 'kept'")
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # three rows at most
        if counts:
            rows = files.join(changes.where("change <> 'removed'").select("dir"), "dir", "left_semi")
            text = skills.combined(F.col("name"), F.col("tags"), F.col("description"), skills.section(F.col("text"), "When to Use"), skills.section(F.col("text"), "Examples"))
            vector = lambda c: normalize(self.embed.documents(c)).cast("array<float>")
            made = rows.select("dir", "name", "description", "tags", text.alias("text"), "fingerprint", vector(F.col("description")).alias("desc_vec"), vector(F.coalesce(skills.section(F.col("text"), "Examples"), F.lit(""))).alias("examples_vec"))
            self.table.replace(changes.select("dir"), made)
        return counts

    def search(self, query: str, k: int = 3, least: float = skills.CUT) -> DataFrame:
        """(dir, score, name, tags, description)."""
        rows = self.table.read()
        q = list(self.spark.range(1).select(normalize(self.embed.queries(F.lit(query))).alias("v")).first()["v"])
        terms = [r["w"] for r in self.spark.range(1).select(F.explode(words(F.lit(query))).alias("w")).collect()]
        said = retrieve.bm25(rows, terms, "dir").orderBy(F.desc("score"), "dir").limit(k)
        hits = skills.retrieve(rows, skills.two_channels(rows, q, k), said, q, least=least)
        return hits.join(rows.select("dir", "name", "tags", "description"), "dir").orderBy(F.desc("score"), "dir")


def skill_tools(index: SkillIndex, registry: Registry) -> None:
    def search(query: str, top_k: int = 5) -> str:
        if not query.strip():
            raise ValueError("a query is needed")
        index.ensure()
        rows = index.search(query).limit(int(top_k)).collect()
        return json.dumps([{"dir": r["dir"], "name": r["name"], "tags": r["tags"], "description": (r["description"] or "")[:200], "score": round(r["score"], 4)} for r in rows], ensure_ascii=False) if rows else "no skill was found"

    registry.register(Tool("skill_semantic_search", "Find a skill by its meaning.", search, props(query="string", top_k="integer")))


def web_tools(spark: SparkSession, registry: Registry, fetch: Callable[[str], tuple[int, str]] | None = None) -> None:
    """S19 on a page that is fetched by the driver; ``fetch`` returns (status, body)."""

    def get(url: str) -> tuple[int, str]:
        if not url.startswith(("http://", "https://")):
            raise ValueError("only http and https are fetched")
        try:
            with urllib.request.urlopen(url, timeout=30) as r:
                return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""

    def run(url: str, raw: bool = False) -> str:
        status, body = (fetch or get)(url)
        if status >= 400:
            raise ValueError(f"HTTP {status}")
        if raw:
            return body[:20_000]
        return spark.createDataFrame([(body,)], "html string").select(scan.web_text(F.col("html"))).first()[0]

    registry.register(Tool("web_scan", "Visible text of a page.", run, props(url="string", raw="boolean")))


def file_tools(root: str, registry: Registry) -> None:
    def read(path: str) -> str:
        return inside(root, path).read_text("utf-8", "replace")

    def write(path: str, content: str) -> str:
        p = inside(root, path)
        p.parent.mkdir(parents=True, exist_ok=True)
        tmp = p.with_name(p.name + ".tmp")
        tmp.write_text(content, "utf-8")
        tmp.replace(p)
        return f"{len(content)} characters"

    def modify(path: str, old: str, new: str, all: bool = False) -> str:
        text = read(path)
        if old not in text:
            raise ValueError("the text to replace was not found")
        return write(path, text.replace(old, new) if all else text.replace(old, new, 1))

    registry.register(Tool("file_read", "Read a file.", read, props(path="string")))
    registry.register(Tool("file_write", "Write a file.", write, props(path="string", content="string")))
    registry.register(Tool("file_modify", "Replace text in a file.", modify, props(path="string", old="string", new="string", all="boolean")))
    registry.register(Tool("skill_load", "Read a skill's prompt.", lambda path, entry="prompt.md": read(f"{path}/{entry}"), props(path="string", entry="string")))
