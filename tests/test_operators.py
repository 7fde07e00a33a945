"""Operators on hand-written cases: chunking, cleaning, outlines, parsers, sync, memory, streaming, tools."""

from __future__ import annotations

import io
import json
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright import plans, schemas
from loomwright.functions import outline as O
from loomwright.functions import text as X
from loomwright.functions import vectors as V
from loomwright.operators import chunk as K
from loomwright.operators import conversation as H
from loomwright.operators import deps, graph, retrieve, skills, sync
from loomwright.operators.memory import DailyFacts, FactStore, KeyValueStore, append_summary, prompt
from loomwright.functions.vectors import BigramEmbedding, ModelScorer
from loomwright.plans import index
from loomwright.plans.engine import Engine
from loomwright.sinks.tables import Conflict, VersionedTable
from loomwright.sources import parsers, scan
from loomwright.streaming import ingest as S
from loomwright.tools import Graph, Registry, SkillIndex, Tool, file_tools, graph_tools, inside, memory_tools, parse_args, retrieval_tools, skill_tools, table_tools, web_tools


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def cost(s):
    w = sum("一" <= c <= "鿿" for c in s)
    return w // 2 + (len(s) - w) // 3


# Chunks


SENTENCE = re.compile(r"(?<=[.?!？！。])\s*|\n")
BLANK_LINE = re.compile(r"\n\s*\n")


def full(parts):
    return [x for x in (p.strip() for p in parts) if x]


def tail_by_hand(text, most):
    parts = [p for p in SENTENCE.split(text) if p and p.strip()]
    out, n = [], 0
    for p in reversed(parts):
        if out and n + cost(p) > most:
            break
        out.insert(0, p)
        n += cost(p)
    return "".join(out).strip()


def hybrid_by_hand(text, size, least, share):
    if not text.strip():
        return []
    if re.search(r"(?m)^#{1,6}\s+\S", text):
        parts = full(re.split(r"(?m)(?=^#{1,6}\s+\S)", text))
    else:
        parts = full(BLANK_LINE.split(text))

    def pack(ps, ok):
        out = []
        for p in ps:
            if out and ok(out[-1], p):
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return out

    flat = []
    for p in parts:
        flat += [p] if cost(p) <= size else pack(full(BLANK_LINE.split(p)), lambda a, b: cost(a) + cost(b) <= size)
    merged = pack(flat, lambda a, b: cost(a) < least and cost(a) + cost(b) <= size)
    out = merged[:1]
    for before, c in zip(merged, merged[1:]):
        t = tail_by_hand(before, int(size * share))
        out.append(t + "\n\n" + c if t else c)
    return out


def test_hybrid_is_the_plain_version(spark):
    rng = random.Random(4)
    texts = ["", "  \n ", "# A\nbody", "intro.\n\n## B\n" + "word. " * 300]
    for _ in range(60):
        t = ""
        for _ in range(rng.randint(1, 12)):
            t += rng.choice(["# H\n", "\n\n", "\n", "## 标题\n", ""]) + " ".join(rng.choice(["ab", "汉字。", "end.", "q?", "x"]) for _ in range(rng.randint(0, 60)))
        texts.append(t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", K.hybrid(F.col("t"), 60, 20, 0.2).alias("c"))
    got = {r["i"]: r["c"] for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == hybrid_by_hand(t, 60, 20, 0.2), t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n汉。", max_size=400), st.integers(5, 40))
def test_recursive_invariants(text, size):
    chunks = K.split_recursive(text, size, size // 4)
    assert all(c.strip() for c in chunks)
    assert bool(chunks) == bool(text.strip())
    if cost(text) <= size:
        assert chunks == ([text] if text.strip() else [])
    joined = "".join(chunks)
    assert all(joined.count(c) >= 1 for c in set(text) - set(". \n。"))


def test_recursive_counts_each_character_a_few_times(monkeypatch):
    text, seen = ("a few words. " * 40 + "\n") * 200, []
    want = K.split_recursive(text, 200, 20)
    wide = K._wide
    monkeypatch.setattr(K, "_wide", lambda s: (seen.append(len(s)), wide(s))[1])
    assert K.split_recursive(text, 200, 20) == want and len(want) > 100
    assert sum(seen) < 12 * len(text)


@given(st.text(alphabet="ab 汉é", max_size=80), st.integers(0, 9), st.integers(0, 80))
def test_reach_at_once_is_the_walk(text, n, at):
    at = min(at, len(text))
    assert K._back(text, at, n) == K._reach(text, at, -1, lambda k: k >= n)
    assert K._ahead(text, at, n) == K._reach(text, at, 1, lambda k: "before" if k > n else False)


def test_window_split_and_carry_over():
    assert K.split_window("abc " * 50, 10, 2)[0] == ("abc " * 8).strip()[: 32].strip()
    assert K.carry_over(["aaaaaaaaa", "b"], 2, "-") == ["aaaaaaaaa", "aaaaaa-b"]
    assert K.carry_over(["aa", "b"], 2, "-") == ["aa", "b"]
    assert all(cost(c) <= 10 for c in K.split_window("汉" * 200, 10, 3))


def test_chunkers(spark):
    df = spark.createDataFrame([("a", "First topic here it is. " * 3 + "\n" + "汉字汉字汉字汉字汉字汉字汉字汉字汉字汉字。" * 2)], "k string, t string")
    got = K.semantic(df, "k", "t", V.Md5Embedding(1).documents, 0.99).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and len(got) > 1
    made = spark.createDataFrame([("x" * 9000,)], "x string").select(K.hybrid(F.col("x"), 100).alias("c")).cache()
    strict = made.select(K.strict(F.col("c"), 100).alias("y")).first()["y"]
    assert max(map(cost, strict)) <= 100
    with pytest.raises(ValueError):
        K.chunks_by("none", F.col("x"))
    assert one(spark, "a\n\nb", lambda c: K.chunks_by("paragraph", c, 800)) == ["a\n\nb"]


def test_tokens(spark):
    assert one(spark, "汉字abc", X.estimate_tokens) == 2 and one(spark, "", X.token_count) == 0 and one(spark, "a", X.token_count) == 1
    assert one(spark, "abcdefgh", X.agent_tokens) == 2 and one(spark, "汉字汉", X.agent_tokens) == 2 and one(spark, "é", X.agent_tokens) == 1


# Cleaning


def test_cleaning(spark):
    dirty = "<script>x()</script><p>Hi&nbsp;there</p>​ see https://a.b/c and me@x.org\n12\nPage 3\n第 4 页\n----\n*!*\n\n\n\nEnd　."
    assert one(spark, dirty, X.clean_text) == "Hi there see and\n\nEnd ."
    md = "\n\n a \n\n\n b\n```py\n  x  \n\n\n```\n c \n\n"
    assert one(spark, md, X.normalize_markdown) == "a\n\nb\n```py\n  x  \n\n\n```\nc"
    assert one(spark, "dir/My file!.txt", X.safe_name).startswith("Myfile.txt_")


# Outlines


def test_outline(spark):
    md = "lead\n# One\ntext\n## Two\n\nmore"
    assert [(c["level"], c["title"], c["text"]) for c in one(spark, md, O.chapters)] == [(0, "前言", "lead"), (1, "One", "text"), (2, "Two", "more")]
    assert one(spark, "no headings", O.chapters) == []
    docs = spark.createDataFrame([(1, "Contents\n第一章 开\nPlain\nThis ends，\n第二章 后"), (2, "x\n\nGRAND TITLE\n\ny.\n1.2 Part"), (3, "nothing."), (4, md)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in O.digests(docs).collect()}
    assert got[1]["digest"] == "# 目录\n\n# 第一章 开\n# Plain"
    assert [c["title"] for c in json.loads(got[2]["chapters"])] == ["GRAND TITLE", "1.2 Part"]
    assert got[3]["digest"] == "3" and got[4]["digest"].splitlines()[-1] == "  ## Two"
    for line, ok in [("第二章 → 23", False), ("128 ／ 书", False), ("Good title", True), ("ends.", False), ("三章", False), ("目 录", False), ("ISBN", False)]:
        assert one(spark, line, O.looks_like_title) is ok
    assert one(spark, "[A  b](#x)", O.normalize_title) == "A b"


# Parsers


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_html", ".html"), body)
    return out.getvalue()


DOCX = _zip(word__document_xml='<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
XLSX = _zip(
    xl__workbook_xml='<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="S"/></sheets></workbook>',
    xl__sharedStrings_xml='<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>',
    xl__worksheets__sheet1_xml='<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c/></row></sheetData></worksheet>',
)
PPTX = _zip(ppt__slides__slide1_xml='<p:sld xmlns:p="p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sld>', ppt__slides__slide2_xml='<p:sld xmlns:p="p"/>')


def test_parsers():
    assert parsers.extract(DOCX, "docx") == ("Hello\n\na | b", False)
    assert parsers.extract(XLSX, "xlsx")[0] == "# Sheet: S\nname | 2"
    assert parsers.extract(PPTX, "pptx")[0] == "## Slide 1\nTitle"
    assert parsers.extract(_zip(a_html="<p>One</p><script>x</script>"), "epub")[0] == "One"
    assert parsers.extract(b"a;b\n1;2\n", "csv")[0] == "a | b\n1 | 2" and parsers.extract(b"", "csv")[0] == ""
    assert parsers.extract(b"<nav>n</nav><main>M &amp; m<footer>f</footer></main>", "html")[0] == "M & m"
    assert parsers.extract(b"\x00\x01" + b"k" * 40 + b"\x02short", "mobi")[0] == "k" * 40
    assert parsers.extract(bytes(range(256)), "txt")[0]
    with pytest.raises(ValueError):
        parsers.extract(b"", "jpg")
    assert parsers.is_scan(["", " "]) and parsers.ocr(b"no image") == ""
    parsers.MARKDOWN_PARSERS.append((("rst",), lambda d: "# md" if d else None))
    try:
        assert parsers.extract(b"x", "rst") == ("# md", True) and parsers.extract(b"", "rst") == ("", False)
    finally:
        parsers.MARKDOWN_PARSERS.clear()


# Engine


@pytest.fixture(scope="module")
def knowledge(tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    (root / "sub").mkdir()
    (root / "intro.md").write_text("# Intro\nRetrieval augments answers.\n## Steps\n1. read\n2. answer\n")
    (root / "store.txt").write_text("Vector stores keep embeddings.\n\n  Indented note about cosine similarity.")
    (root / "page.html").write_text("<header>menu</header><main>Best practice is testing.</main><script>x</script>")
    (root / "models.csv").write_text("name,dim\nsmall,128\nlarge,768\n")
    (root / "sub" / "tokens.md").write_text("# Tokens\nCounting 汉字 tokens.\n")
    (root / "report.docx").write_bytes(DOCX)
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "blank.txt").write_text(" \n")
    (root / ".hidden.txt").write_text("secret")
    (root / "image.jpg").write_bytes(b"x")
    return root


def test_engine(spark, knowledge, tmp_path):
    e = Engine(spark, str(knowledge), f"file://{tmp_path}/state")
    assert e.search("anything").count() == 0
    first = e.ingest()
    assert first["files_found"] == 8 and first["files_extracted"] == 6 and first["errors"] == ["bad.docx", "blank.txt"]
    assert {r["source"] for r in retrieve.sources(e.chunks.read()).collect()} == {"intro.md", "store.txt", "page.html", "models.csv", "sub/tokens.md", "report.docx"}
    again = e.ingest()
    assert again["files_skipped"] == 6 and again["files_extracted"] == 0  # failures are tried again
    assert e.ingest(force=True)["files_extracted"] == 6
    n = e.chunks.read().count()
    assert e.chunks.read().select("id").distinct().count() == n
    hits = e.search("vector embeddings cosine", 3).collect()
    assert len(hits) == 3 and "store.txt" in {h["source"] for h in hits}
    assert {h["source"] for h in e.search("tokens", 3, "sub/").collect()} == {"sub/tokens.md"}
    assert "[1] " in e.search_text("embeddings")
    assert [r["doc_name"] for r in e.outline().collect()][0] == "intro.md" and "Steps" in e.outline("INTRO").first()["digest"]
    (knowledge / "store.txt").unlink()
    (knowledge / "intro.md").write_text("# Intro\nAll new words here now.\n")
    third = e.ingest()
    assert third["files_deleted"] == 1 and third["files_extracted"] == 1
    assert e.chunks.read().where("source = 'store.txt'").count() == 0 and e.documents.read().where("doc_name = 'store.txt'").count() == 0
    assert e.refresh_digests() == 0
    r = Registry()
    retrieval_tools(e, r)
    assert r.execute("rag_search", {"query": "words", "top_k": 99}).success and json.loads(r.execute("rag_status").output)["has_kb"]
    assert "intro.md" in r.execute("rag_outline", "{}").output and not r.execute("rag_search", {"nope": 1}).success
    assert e.ingest(cancelled=lambda: True)["cancelled"]
    e.clear()
    assert e.status()["chunks"] == 0


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 7}", f"text number {i}. " * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "source string, text string")
    once = df.groupBy("source").agg(F.max_by("text", F.length("text")).alias("text"))
    for k in range(3):
        once.where(F.abs(F.hash("source")) % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    embed = Engine(spark, str(tmp_path), f"file://{tmp_path}/x").embedded
    table = VersionedTable(spark, f"file://{tmp_path}/chunks", schemas.CHUNKS)
    seen = []
    for _ in range(2):  # the second run finds nothing new
        q = S.ingest(S.documents(spark, f"{tmp_path}/in", 1), table, embed, f"{tmp_path}/ck", seen.append)
        q.awaitTermination()
    want = embed(K.chunk_documents(once, K.hybrid(F.col("text"))))
    assert len(seen) >= 2 and sorted(table.read().select("id", "text").collect()) == sorted(want.select("id", "text").collect())
    table.vacuum()
    assert table.read().count() == want.count()
    counts = S.request_counts(df).collect()
    assert sum(r["n"] for r in counts) == 20


# Sync, graph, skills, conversations


def test_sync(spark):
    old = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1), ("c", 1.0, 1)], "source string, mtime double, size long")
    new = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("d", 1.0, 1)], "source string, mtime double, size long")
    assert {r["source"]: r["status"] for r in sync.diff(new, old).collect()} == {"a": "unchanged", "b": "modified", "d": "new"}
    assert {r["status"] for r in sync.diff(new, old, True).collect()} == {"new", "modified"}
    assert [r["source"] for r in sync.deleted(new, old).collect()] == ["c"] and sync.deleted(new.limit(0), old).count() == 3
    assert one(spark, "a%b%", lambda c: sync.replace_first(c, "%", "_")) == "a_b%" and one(spark, "ab", lambda c: sync.replace_first(c, "%", "_")) == "ab"


def test_retrieval_edges(spark):
    c = spark.createDataFrame([(0, "s", "the cat"), (1, "s", "the dog the"), (2, "t", "")], "id int, source string, text string")
    assert retrieve.bm25(c, [], "id").count() == 0 and retrieve.bm25(c, ["none"], "id").count() == 0
    assert [r["id"] for r in retrieve.bm25(c, ["the"], "id").orderBy(F.desc("score")).collect()] == [1, 0]
    s = spark.createDataFrame([(1.2,), (1.5,), (0.9,)], "s double")
    assert [round(r[0], 4) for r in s.select(retrieve.rescore(F.col("s"))).collect()] == [0.28, 0.0, 0.9]
    assert [r[0] for r in s.select(retrieve.rescore(F.col("s"), "sane")).collect()][0] < 1
    hits = spark.createDataFrame([(i, "x" * 3000, "s", 1.0 - i / 100) for i in range(10)], "id int, text string, source string, score double")
    got = retrieve.formatted(hits, [F.desc("score")]).collect()
    assert len(got) == 6 and all(len(r["entry"]) < 1520 for r in got)
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "id int, v array<double>")
    assert [r[0] for r in v.select(V.normalize(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    assert [r[0] for r in v.select(V.cosine(F.col("v"), V.literal([1, 0]))).collect()] == [0.0, 0.6]


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, [1.0, -1e-7, 1e-7, -0.0]), (1, [-0.25, 0.5, -3e-7, 0.0]), (2, [0.6, -0.8, 0.0, -4.9e-7])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("v03_normalize", "k16_cosine"):
        got = plans.queries()[name](spark, str(tmp_path)).orderBy("vec_id").collect()
        assert [repr(tuple(r)) for r in got] == [repr(r) for r in duckdb.sql(plans.oracle_sql()[name]).order("vec_id").fetchall()]
    s = spark.createDataFrame([(-4e-5,), (0.00005,), (-0.00015,), (float("nan"),), (None,)], "x double")
    assert [repr(r[0]) for r in s.select(V.rounded(F.col("x"), 4)).collect()] == ["-0.0", "0.0001", repr(duckdb.sql("SELECT round(-0.00015::DOUBLE, 4)").fetchall()[0][0]), "nan", "None"]


def test_graph(spark):
    calls = spark.createDataFrame([(1, " Ann ", "", ["likes tea", "likes tea ", ""]), (2, "ann", "person", ["Likes tea"]), (3, "Bob", "x", [])], "seq int, name string, type string, observations array<string>")
    heads = {r["key"]: r for r in graph.upsert_entities(calls).collect()}
    assert heads["ann"]["name"] == " Ann " and heads["ann"]["type"] == "person"
    obs = graph.observations(calls)
    assert [(r["ord"], r["text"]) for r in obs.orderBy("ord").collect()] == [(1, "likes tea"), (2, "Likes tea")]
    edges = graph.relations(spark.createDataFrame([(1, "Ann", "Bob", "knows"), (2, "ANN", "bob", "Knows"), (3, "Ann", " ", "x"), (4, "Bob", "Cy", "y")], "seq int, source string, target string, label string"))
    assert edges.count() == 2
    left = graph.delete_entities(graph.upsert_entities(calls), edges, obs, spark.createDataFrame([("ANN",)], "name string"))
    assert [x.count() for x in left] == [1, 1, 0]
    assert one(spark, "```json\n{\"entities\": [{\"name\": \"A\"}]}\n```", graph.parse_extraction)["entities"][0]["name"] == "A"
    assert one(spark, "sorry", graph.parse_extraction) is None


def test_skills(spark):
    reg = spark.createDataFrame([(0, "invoice", ["invoice", "bill"]), (1, "mail", ["mail", "bill"])], "pos int, name string, keywords array<string>")
    req = spark.createDataFrame([(0, "Make the BILL"), (1, "mail a bill"), (2, "none")], "id int, text string")
    assert {r["id"]: r["skill"] for r in skills.match(req, reg, "id", "text").collect()} == {0: "invoice", 1: "mail"}
    assert one(spark, "Please sort my the Files, files", skills.request_key) == "files sort"
    assert one(spark, " Big  Skill! ", skills.slug) == "big-skill"
    md = "---\nname: x\ndescription: 'a b'\ntags: [p, \"q\"]\n---\n## Examples\none\n## Other\n"
    m = one(spark, md, skills.frontmatter)
    assert (m["name"], m["description"], m["tags"]) == ("x", "a b", ["p", "q"]) and one(spark, md, lambda c: skills.section(c, "examples")) == "one"
    assert len(set(skills.STOP_WORDS)) == 36


def test_skill_sources(spark, tmp_path):
    for d, text in [("good", "---\nname: g\n---\n"), ("tests/no", "---\nname: n\n---\n"), (".hid/no", "x")]:
        (tmp_path / "md" / d).mkdir(parents=True)
        (tmp_path / "md" / d / "SKILL.md").write_text(text)
    assert [r["name"] for r in scan.skill_files(spark, str(tmp_path / "md")).collect()] == ["g"]
    for d, meta, entry in [("a", {"name": "A"}, "prompt.md"), ("b", {"name": "B", "entry": "x.md"}, "prompt.md"), ("_c", {"name": "C"}, "prompt.md"), ("e", {}, "prompt.md")]:
        (tmp_path / "js" / d).mkdir(parents=True)
        (tmp_path / "js" / d / "skill.json").write_text(json.dumps(meta))
        (tmp_path / "js" / d / entry).write_text("p")
    assert [r["name"] for r in scan.skill_index(spark, str(tmp_path / "js")).collect()] == ["A"]
    (tmp_path / "bad.json").write_text("{")
    assert scan.state(spark, str(tmp_path / "missing.json"), schemas.KV).count() == 0


def test_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "tool" if i in (5,) else "assistant", f"message {i} " + "x" * 30) for i in range(12)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = H.shrink(m).orderBy("turn").collect()
    assert got[0]["turn"] == -1 and "message 0" in got[0]["text"] and [r["turn"] for r in got[1:]] == [6, 7, 8, 9, 10, 11]
    assert [r["turn"] for r in H.trim(m, 7).orderBy("turn").collect()] == [6, 7, 8, 9, 10, 11]
    assert H.shrink(m.where("turn < 8")).count() == 8
    assert H.recent(m).count() == 6 and H.recent(m.withColumn("text", F.lit("hi"))).count() == 0
    def piece(seq, **call):
        delta = dict(tool_calls=[dict(index=0, **call)])
        return 1, seq, "data: " + json.dumps(dict(choices=[dict(delta=delta)]))

    lines = [piece(0, id="c1", function=dict(name="f", arguments='{"a"')), piece(1, function=dict(arguments=": 1}")), (1, 2, "data: [DONE]")]
    call = H.fold_tool_calls(spark.createDataFrame(lines, "stream_id int, seq int, line string")).first()
    assert (call["id"], call["name"], call["arguments"]) == ("c1", "f", '{"a": 1}')
    sp = H.speed(spark.createDataFrame([(1, "abcdefgh", 0.0), (1, "abcd", 2.0)], "turn_id int, text string, t double").withColumn("ts", F.timestamp_seconds("t"))).first()
    assert sp["tokens"] == 3 and sp["per_second"] == 1.5
    assert one(spark, "Prompt too long!", H.is_too_long) is True


def test_deps(spark):
    f = spark.createDataFrame([("a.PDF",), ("b/.x.docx",), ("c.txt",)], "path string")
    got = {r["pip_spec"]: r["required"] for r in deps.required(f).collect()}
    assert got["PyMuPDF"] is True and got["rapidocr-onnxruntime"] is False and "python-docx" not in got
    assert deps.required(f, image_pdf=True).where("pip_spec like 'rapid%' and required").count() == 1
    assert "PyMuPDF" in deps.summary(deps.required(f), {"numpy"}) and "installed" in deps.summary(deps.required(f.limit(0)), {"numpy", "pyarrow"})


# Memory and tools


def test_memory(tmp_path):
    t = [0.0]
    kv = KeyValueStore(f"{tmp_path}/kv.json", clock=lambda: t[0])
    kv.set("a", 1)
    kv.set("b", 2)
    assert KeyValueStore(f"{tmp_path}/kv.json").all() == {"a": 1}
    t[0] = 1.0
    assert kv.delete("a") and not kv.delete("a")
    assert KeyValueStore(f"{tmp_path}/kv.json").all() == {"b": 2}
    (tmp_path / "bad.json").write_text("[1")
    assert KeyValueStore(f"{tmp_path}/bad.json").all() == {}
    facts = FactStore(kv)
    assert facts.add_many(["x", "x", " ", "Y"]) == 2 and not facts.add("x") and facts.search("y") == ["Y"]
    day = DailyFacts(kv)
    assert day.append(["p", "q", "p"], "d1") == ["p", "q"] and day.append(["r"], "d2") == ["r"] and day.facts("d1") == []
    append_summary(f"{tmp_path}/m.md", "s", "now")
    assert "## now" in (tmp_path / "m.md").read_text()
    assert "and 2 more" in prompt(["f"], {"k": "v" * 300}, "s", [str(i) for i in range(10)])
    r = Registry()
    memory_tools(kv, r)
    assert r.execute("work_memory", dict(op="get", key="b")).output == "2" and not r.execute("work_memory", {"op": "no"}).success


def test_tools(spark, tmp_path):
    r = Registry()
    file_tools(str(tmp_path), r)
    assert r.execute("file_write", {"path": "d/x.txt", "content": "aa"}).success
    assert r.execute("file_modify", {"path": "d/x.txt", "old": "a", "new": "b"}).success and r.execute("file_read", {"path": "d/x.txt"}).output == "ba"
    assert "PermissionError" in r.execute("file_read", dict(path="../x")).error and not r.execute("file_modify", {"path": "d/x.txt", "old": "zz", "new": ""}).success
    assert not r.execute("unknown").success and parse_args("{") == {} and parse_args("[1]") == {} and parse_args(None) == {}
    with pytest.raises(PermissionError):
        inside(str(tmp_path), "/etc/passwd")
    obs = spark.createDataFrame([("ann", 1, "likes tea")], "key string, ord long, text string")
    reg = spark.createDataFrame([("tea maker", "brews tea", ["tea"], [])], "name string, description string, keywords array<string>, tags array<string>")
    table_tools(obs, None, reg, lambda q: [], r)
    assert "likes tea" in r.execute("memory_search", {"query": "TEA"}).output and "tea maker" in r.execute("skill_search", {"query": "tea"}).output
    assert r.execute("memory_graph", {"op": "snapshot"}).success and not r.execute("memory_graph", {"op": "x"}).success
    r.register(Tool("boom", "", lambda: 1 / 0))
    assert "ZeroDivisionError" in r.execute("boom").error and len(r.schemas()) == len(r.names())


def test_tables_survive_crashes_and_other_writers(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    schema = "source string, n long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    table = VersionedTable(spark, root, make(("a", 1)).schema)
    assert table.version() == 0 and table.read().count() == 0
    table.commit(make(*[(f"s{i}", i) for i in range(40)]))
    before = table._folders(1)
    table.replace_by_source(make(("s3", 100)))
    after = table._folders(2)
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket is written, the others stay
    assert {r["source"]: r["n"] for r in table.read().collect()} == {f"s{i}": 100 if i == 3 else i for i in range(40)}
    # a crash before the commit leaves what was there
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.commit(make(("x", 1)))
    (tmp_path / "t/commits/.half").write_text("{")
    assert table.version() == 2 and table.read().count() == 40
    # two writers from one version: the second begins again, a plain commit fails
    write, other = VersionedTable._write, VersionedTable(spark, root, table.schema)
    with monkeypatch.context() as m:
        done = []

        def late(self, rows):
            out = write(self, rows)
            if self is table and not done:
                done.append(other.replace_by_source(make(("s4", 400))))
            return out

        m.setattr(VersionedTable, "_write", late)
        table.replace_by_source(make(("s5", 500)))
        done.clear()
        with pytest.raises(Conflict):
            table.commit(make(("x", 1)))
    got = {r["source"]: r["n"] for r in table.read().collect()}
    assert got["s4"] == 400 and got["s5"] == 500 and len(got) == 40
    table.delete_by_source("s5")
    table.vacuum()
    assert table.read().count() == 39
    table.clear()
    assert table.read().count() == 0


def test_indexed_search_is_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 3}", " ".join(["cat", "dog", "bird"][j % 3] for j in range(i % 7 + i % 2))) for i in range(30)], "id long, source string, text string")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    found = index.of_table(rows, "id")
    for where in (None, F.col("source").contains("1")):
        want = {r["id"]: round(r["score"], 9) for r in retrieve.bm25(rows if where is None else rows.where(where), ["cat", "bird", "cow"], "id").collect()}
        assert {int(r["id"]): round(r["score"], 9) for r in found.search(["cat", "bird", "cow"], where).collect()} == want
    assert found.search([]).count() == 0
    plan = found.search(["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "cat" in plan


def test_postings_are_counted_in_their_row(spark, tmp_path):
    texts = ["b a b", "", None, "c", "a a a c b a", "b a b"]
    rows = spark.createDataFrame([(min(i, 4), "s", t) for i, t in enumerate(texts)], "id long, source string, text string")
    rows.write.parquet(f"{tmp_path}/rows")
    made = retrieve.indexed_postings(spark.read.parquet(f"{tmp_path}/rows"), "id")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = sorted((w, str(min(i, 4)), "s", t.split().count(w), len(t.split())) for i, t in enumerate(texts) if t for w in set(t.split()))
    assert sorted(tuple(r) for r in made.collect()) == want
    # rows of one id and length are one document, as in the SQL
    twice = spark.createDataFrame([("a", "1", "s", 1, 3), ("a", "1", "s", 2, 3), ("a", "2", "s", 3, 3)], schemas.POSTINGS)
    once = spark.createDataFrame([("a", "1", "s", 3, 3), ("a", "2", "s", 3, 3)], schemas.POSTINGS)
    lengths = spark.createDataFrame([("s", 3, 9)], schemas.LENGTHS)
    assert sorted(retrieve.bm25_indexed(twice, lengths, ["a"]).collect()) == sorted(retrieve.bm25_indexed(once, lengths, ["a"]).collect())


def test_scorer_and_fallback(spark):
    rows = spark.createDataFrame([(i, "x" * i, 2.0 - i / 10, i) for i in range(8)], "id int, text string, score double, merged int")
    good = ModelScorer(lambda: lambda q, texts: [len(t) - 4.0 for t in texts], "length")
    got = retrieve.rerank_or_fallback(rows, good.scores("q", F.col("text")), 3).collect()
    assert [r["id"] for r in got] == [7, 6, 5] and abs(got[0]["rerank_score"] - 1 / (1 + 2.718281828459045**-3)) < 1e-9
    low = retrieve.rerank_or_fallback(rows, good.scores("q", F.col("text")), 3, least=0.999).select("id").collect()
    bad = ModelScorer(lambda: 1 / 0, "broken")
    plain = retrieve.rerank_fallback(rows, 3).select("id").collect()
    assert retrieve.rerank_or_fallback(rows, bad.scores("q", F.col("text")), 3).select("id").collect() == plain == low
    assert bad.state() == "idle" and bad.model() is None and bad.state() == "failed" and good.model() and good.state() == "done"


def test_semantic_chunks_and_chain(spark):
    text = "Cats sleep all day long here. Cats sleep all day long too. Rockets fly to the moon fast. Rockets fly to the moon again. "
    docs = spark.createDataFrame([("a", text), ("b", " \n"), ("c", None)], "source string, text string")
    embed = BigramEmbedding().documents
    parts = K.semantic(docs, "source", "text", embed, 0.7).orderBy("chunk_index").collect()
    assert [r["text"].count(".") for r in parts] == [2, 2]
    whole = {r["source"]: r["chunks"] for r in K.semantic_chunks(docs, "source", "text", embed, 800, 5, 0.0, 0).collect()}
    assert whole["a"] == [r["text"] for r in parts]
    chain = {r["source"]: (r["strategy"], r["chunks"]) for r in K.with_fallback(docs, "source", "text", embed).collect()}
    assert chain["a"][0] == "hybrid" and chain["a"][1] and not chain["b"][1] and not chain["c"][1]


def test_tool_calls_count(spark):
    schema = "conv_id long, turn long, role string, text string, tool_calls array<struct<id:string,name:string,arguments:string>>"
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", [("c", "search", "{}")] if i == 1 else None) for i in range(12)]
    m = spark.createDataFrame(rows, schema)
    assert H.totals(m).first()["tokens"] > H.totals(m.drop("tool_calls")).first()["tokens"]
    said = H.shrink(m).where("turn = -1").first()["text"]
    assert said.startswith("用户请求: m0 | m2") and said.endswith("; 调用过的工具: search")


def test_graph_store_and_skill_index(spark, tmp_path):
    r = Registry()
    graph_tools(Graph(spark, f"file://{tmp_path}/g"), r)
    call = lambda **a: r.execute("memory_graph", a)
    assert json.loads(call(op="create_entity", name="Ann", entity_type="person", observations=["likes tea", " "]).output) == {"added": 1}
    assert json.loads(call(op="add_observations", name="ann", observations=["likes tea", "is tall"]).output) == {"added": 1}
    assert call(op="create_relation", source="Ann", target="Bob", label="knows").output == "created" and call(op="create_relation", source="ann", target="BOB", label="Knows").output.startswith("duplicate")
    assert json.loads(call(op="get_entity", name="ANN").output) == {"name": "Ann", "type": "person", "observations": ["likes tea", "is tall"]}
    assert json.loads(call(op="list_entities").output) == ["Ann (person) [2]", "Bob (?) [0]"]
    assert call(op="snapshot").output == "- Ann (person): likes tea; is tall\n- Ann --[knows]--> Bob"
    assert call(op="delete_entity", name="bob").output == "deleted" and call(op="snapshot").output == "- Ann (person): likes tea; is tall"
    assert not call(op="create_entity").success and not call(op="x").success and call(op="clear").output == "cleared" and call(op="snapshot").output == "(empty)"
    for name in ("tea", "run"):
        (tmp_path / "skills" / name).mkdir(parents=True)
        (tmp_path / "skills" / name / "SKILL.md").write_text(f"---\nname: {name}\ndescription: how to {name}\n---\n## Examples\nmake {name}\n")
    found = SkillIndex(spark, f"{tmp_path}/skills", f"file://{tmp_path}/state", BigramEmbedding())
    assert found.ensure() == {"added": 2} and found.ensure() == {}
    skill_tools(found, r)
    assert "tea" in r.execute("skill_semantic_search", {"query": "how to tea"}).output and not r.execute("skill_semantic_search", {"query": " "}).success
    (tmp_path / "skills/run/SKILL.md").unlink()
    assert found.ensure() == {"removed": 1}
    web_tools(spark, r, lambda url: (404, "") if "no" in url else (200, "<p>hi</p><script>x</script>\n\n<b>you</b>"))
    assert r.execute("web_scan", {"url": "http://a"}).output == "hi\nyou" and "404" in r.execute("web_scan", {"url": "http://no"}).error and "<p>" in r.execute("web_scan", {"url": "http://a", "raw": True}).output
