"""Queries over texts: cleaning, tokens, chunks, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outline as O
from ..functions import text as X
from ..operators import chunk as K
from ..operators import deps, sync
from ..sources import scan
from .registry import query

#: A path made from a row, in Spark and in DuckDB.
PATH = "concat('kb/', source, CASE WHEN doc_id % 11 = 0 THEN '/.hid' ELSE '/' END, 'doc ', cast(doc_id AS STRING), '.', CASE doc_id % 5 WHEN 0 THEN 'TXT' WHEN 1 THEN 'md' WHEN 2 THEN 'html' WHEN 3 THEN 'Pdf' ELSE 'docx' END)"
PATH_SQL = PATH.replace("STRING", "VARCHAR")
EXT_SQL = f"(SELECT lower(regexp_extract(p, '\\.([^.]+)$', 1)) AS ext FROM (SELECT regexp_extract({PATH_SQL}, '([^/]*)$', 1) AS p FROM documents) WHERE p NOT LIKE '.%')"


@query("s02_extension_counts", f"SELECT ext AS suffix, count(*) AS n FROM {EXT_SQL} GROUP BY ext")
def s02(t):
    return scan.counts(t("documents").select(deps.extension(F.expr(PATH)).alias("suffix")).where("suffix is not null"))


@query("s18_extensions", f"SELECT DISTINCT ext FROM {EXT_SQL}")
def s18(t):
    return scan.extensions(t("documents").select(F.expr(PATH).alias("source")))


@query("s07_html_regex", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def s07(t):
    return t("pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("h"))


_WEB = X.rule_sql(X.rule_sql("html", "c01"), "c03")
_WEB_LINES = r"list_filter(list_transform(string_split({0}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')"


@query("s19_web_scan", f"SELECT page_id, md5(substr(array_to_string({_WEB_LINES.format(_WEB)}, chr(10)), 1, 20000)) AS h FROM pages")
def s19(t):
    return t("pages").select("page_id", F.md5(scan.web_text(F.col("html"))).alias("h"))


@query("c16_web_lines", f"SELECT doc_id, md5(substr(array_to_string({_WEB_LINES.format('text')}, chr(10)), 1, 20000)) AS h FROM documents")
def c16(t):
    return t("documents").select("doc_id", F.md5(X.web_text(F.col("text"))).alias("h"))


def _rule(name: str) -> None:
    short = {"c01": "blocks", "c02": "comments", "c03": "tags", "c04": "entities", "c05": "urls", "c06": "mail", "c07": "controls", "c08": "spaces", "c09": "zero_width", "c10": "blanks"}[name]
    # characters that the tables lack follow each text
    odd = "chr(7), 'a', {0}, 'b', {1}, 'see https://x.y/z?q=1 or me@x.org, ', chr(9), chr(9), '&amp;&#12;&#xAf; <!-- c --><script>x</script><b>y</b>'"
    sql, spark = odd.format("chr(8203)", "chr(8195)"), odd.format("decode(unhex('E2808B'), 'UTF-8')", "decode(unhex('E28083'), 'UTF-8')")
    both = f"(SELECT 'page' AS kind, page_id AS id, concat(html, {sql}) AS x FROM pages UNION ALL SELECT 'document', doc_id, concat(text, {sql}) FROM documents)"

    @query(f"{name}_{short}", f"SELECT kind, id, md5({X.rule_sql('x', name)}) AS h FROM {both}")
    def run(t):
        rows = t("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.expr(f"concat(html, {spark})").alias("x"))
        rows = rows.union(t("documents").select(F.lit("document"), "doc_id", F.expr(f"concat(text, {spark})")))
        return rows.select("kind", "id", F.md5(X.apply_rule(F.col("x"), name)).alias("h"))


for _name in X.RULES:
    _rule(_name)

_LINED = "concat(replace(text, '. ', '.\n'), '\n12\n', 'Page 7', '\n-----\n**!!\n', text)"


@query("c11_c13_line_noise", f"SELECT doc_id, md5({X.lines_sql('x')}) AS h FROM (SELECT doc_id, {_LINED} AS x FROM documents)")
def c11(t):
    rows = t("documents").select("doc_id", F.expr(_LINED.replace("\n", "\\n")).alias("x"))
    return rows.select("doc_id", F.md5(X.strip(F.regexp_replace(X.clean_lines(F.col("x")), "\n{3,}", "\n\n"))).alias("h"))


@query("c12_page_lines", r"""
SELECT page_id, s, regexp_full_match(s, '\d{1,4}') OR regexp_full_match(s, '第\s*\d{1,4}\s*页') OR regexp_full_match(s, '(?i)page\s+\d{1,4}') OR regexp_full_match(s, '[\-=_*#~]{3,}\s*') AS noise
FROM (SELECT page_id, unnest([page_id::VARCHAR, '第 ' || page_id || ' 页', 'PAGE ' || page_id, 'page' || page_id, repeat('=', (page_id % 5)::INT), '页 ' || page_id]) AS s FROM pages)""")
def c12(t):
    p = F.col("page_id").cast("string")
    made = F.array(p, F.concat(F.lit("第 "), p, F.lit(" 页")), F.concat(F.lit("PAGE "), p), F.concat(F.lit("page"), p), F.expr("repeat('=', cast(page_id % 5 as int))"), F.concat(F.lit("页 "), p))
    rows = t("pages").select("page_id", F.explode(made).alias("s"))
    hit = F.lit(False)
    for pattern in (*X.PAGE_LINES, X.SEPARATOR_LINE):
        hit = hit | F.col("s").rlike(pattern)
    return rows.select("page_id", "s", hit.alias("noise"))


@query("c14_clean_text_pages", f"SELECT page_id, md5({X.clean_sql('html')}) AS h, length({X.clean_sql('html')}) AS n FROM pages")
def c14p(t):
    return t("pages").select("page_id", X.clean_text(F.col("html")).alias("x")).select("page_id", F.md5("x").alias("h"), F.length("x").alias("n"))


@query("c14_clean_text_documents", f"SELECT doc_id, md5({X.clean_sql('text')}) AS h FROM documents")
def c14d(t):
    return t("documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("h"))


@query("c15_normalize_markdown", f"SELECT doc_id, md5({X.markdown_sql(chr(114) + 'eplace(text, chr(10), chr(10) || chr(10) || chr(32) || chr(10))')}) AS h FROM documents")
def c15(t):
    return t("documents").select("doc_id", F.md5(X.normalize_markdown(F.replace("text", F.lit("\n"), F.lit("\n\n \n")))).alias("h"))


@query("c17_safe_name", rf"SELECT doc_id, substr(regexp_replace(regexp_extract({PATH_SQL}, '([^/]*)$', 1), '[^\p{{L}}\p{{N}}._-]', '', 'g'), 1, 32) || '_' || substr(md5({PATH_SQL}), 1, 12) AS name FROM documents")
def c17(t):
    return t("documents").select("doc_id", X.safe_name(F.expr(PATH)).alias("name"))


_CJK = "concat(text, repeat('汉字', cast(doc_id % 50 AS INT)), 'ｶﾅ')"


@query("k01_estimate_tokens", f"SELECT doc_id, {X.tokens_sql('x')} AS tokens FROM (SELECT doc_id, {_CJK} AS x FROM documents)")
def k01(t):
    return t("documents").select("doc_id", X.estimate_tokens(F.expr(_CJK)).alias("tokens"))


#: Whole texts, and beside them texts of no and of few characters.
_TINY = "text, '', 'a', '汉', 'ab汉'"


@query("k02_token_count", f"SELECT doc_id, x = text AS whole, CASE WHEN length(x) = 0 THEN 0 ELSE greatest({X.tokens_sql('x')}, 1) END AS tokens FROM (SELECT doc_id, text, unnest([{_TINY}]) AS x FROM documents)")
def k02(t):
    rows = t("documents").select("doc_id", "text", F.explode(F.expr(f"array({_TINY})")).alias("x"))
    return rows.select("doc_id", (F.col("x") == F.col("text")).alias("whole"), X.token_count(F.col("x")).alias("tokens"))


@query("k17_agent_tokens", f"SELECT doc_id, {X.agent_tokens_sql('x')} AS tokens FROM (SELECT doc_id, {_CJK} AS x FROM documents)")
def k17(t):
    return t("documents").select("doc_id", X.agent_tokens(F.expr(_CJK)).alias("tokens"))


_PARAS = "replace(text, '\n', '\n \n')"


@query("k10_paragraph_chunks", rf"""
SELECT source, doc_id, (i - 1)::INT AS chunk_index, md5(c[i]) AS h FROM (
  SELECT source, doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (
    SELECT source, doc_id, list_filter(list_transform(regexp_split_to_array({_PARAS}, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS c FROM documents))""")
def k10(t):
    rows = t("documents").select("source", "doc_id", K.split_paragraphs(F.expr(_PARAS.replace("\n", "\\n"))).alias("c"))
    return rows.select("source", "doc_id", F.posexplode("c").alias("chunk_index", "x")).select("source", "doc_id", "chunk_index", F.md5("x").alias("h"))


#: Every third line break begins a heading.
_HEADED = "regexp_replace(replace(text, '. ', '.\n'), '\n([A-Z][^\n]{5,40})\n', '\n## $1\n')"
_HEADED_SQL = "regexp_replace(replace(text, '. ', '.\n'), '\n([A-Z][^\n]{5,40})\n', '\n## \\1\n', 'g')"


@query("k09_structure_chunks", rf"""
SELECT doc_id, (i - 1)::INT AS chunk_index, md5(c[i]) AS h FROM (
  SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(CASE WHEN regexp_matches(x, '(?m)^#{{1,6}}\s+\S')
      THEN string_split(regexp_replace(x, '(?m)^(#{{1,6}}\s+\S)', chr(1) || '\1', 'g'), chr(1)) ELSE regexp_split_to_array(x, '\n\s*\n') END,
      lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS c
    FROM (SELECT doc_id, {_HEADED_SQL} AS x FROM documents)))""")
def k09(t):
    rows = t("documents").select("doc_id", F.expr(_HEADED.replace("\n", "\\n")).alias("x")).select("doc_id", F.posexplode(K.split_structure(F.col("x"))).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.md5("c").alias("h"))


@query("k06_chunk_ids", rf"""
SELECT substr(md5(source), 1, 12) || '_' || (i - 1) AS id, count(*) AS n, max(length(c[i])) AS longest FROM (
  SELECT source, c, unnest(range(1, len(c) + 1)) AS i FROM (
    SELECT source, list_filter(list_transform(regexp_split_to_array({_PARAS}, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS c FROM documents)) GROUP BY ALL""")
def k06(t):
    rows = K.chunk_documents(t("documents"), K.split_paragraphs(F.expr(_PARAS.replace("\n", "\\n"))))
    return rows.groupBy(sync.chunk_id(F.col("source"), F.col("chunk_index")).alias("id")).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("k08_hybrid_chunks")
def k08(t):
    """Sections, paragraph groups, merge and overlap; held against a plain Python version in the tests."""
    return K.chunk_documents(t("documents").select(F.col("doc_id").cast("string").alias("source"), F.expr(_HEADED.replace("\n", "\\n")).alias("x")), K.hybrid(F.col("x")))


@query("k03_recursive_chunks")
def k03(t):
    return K.chunk_documents(t("documents").select(F.col("doc_id").cast("string").alias("source"), "text"), K.recursive(F.col("text"), 200, 20))


@query("k11_semantic_chunks")
def k11(t):
    from ..functions.vectors import Md5Embedding

    return K.semantic(t("documents"), "doc_id", "text", Md5Embedding(1).documents)


@query("k13_merge_small")
def k13(t):
    return K.chunk_documents(t("documents").select(F.col("doc_id").cast("string").alias("source"), "text"), K.merge_small(K.split_paragraphs(F.expr(_PARAS.replace("\n", "\\n")))))


@query("k14_overlap")
def k14(t):
    return K.chunk_documents(t("documents").select(F.col("doc_id").cast("string").alias("source"), "text"), K.overlap(K.split_paragraphs(F.expr(_PARAS.replace("\n", "\\n")))))


@query("d01_chapters", rf"""
SELECT doc_id, level, title, md5(body) AS h FROM (
  SELECT doc_id, headed, length(regexp_extract(p, '^(#{{1,6}})[ \t]+', 1)) AS level,
    CASE WHEN regexp_matches(p, '^#{{1,6}}[ \t]+') THEN regexp_replace(regexp_extract(p, '^#{{1,6}}[ \t]+([^\n]*)', 1), '^\s+|\s+$', '', 'g') ELSE '前言' END AS title,
    regexp_replace(regexp_replace(p, '^#{{1,6}}[ \t]+[^\n]*', ''), '^\s+|\s+$', '', 'g') AS body
  FROM (SELECT doc_id, regexp_matches(x, '(?m)^#{{1,6}}[ \t]+') AS headed, unnest(string_split(regexp_replace(x, '(?m)^(#{{1,6}}[ \t]+)', chr(1) || '\1', 'g'), chr(1))) AS p FROM (SELECT doc_id, {_HEADED_SQL} AS x FROM documents)))
WHERE headed AND (level > 0 OR body <> '')""")
def d01(t):
    rows = t("documents").select("doc_id", F.explode(O.chapters(F.expr(_HEADED.replace("\n", "\\n")))).alias("c"))
    return rows.select("doc_id", "c.level", "c.title", F.md5("c.text").alias("h"))


@query("d02_split_lines", r"SELECT doc_id, (i - 1)::INT AS pos, md5(regexp_replace(c[i], '^\s+|\s+$', '', 'g')) AS h FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents))")
def d02(t):
    return O.numbered_lines(t("documents"), "doc_id", "text").select("doc_id", "pos", F.md5("line").alias("h"))


#: Lines of every shape that the outline rules know, by page.
_SHAPES = "array('第' || page_id || '章 起源', '第三节：方法', (page_id % 20) || '.2.1 Scope of it', '3、' || page_id, 'GENERAL TERMS ' || page_id, 'A title without an end', 'It ends.', '第二章 → 23', 'Chapter one ' || page_id, '128 ／ 薄伽梵歌', '三章', '2007 年12月', 'ISBN', '目录', '[Intro  part](#a' || page_id || ')', '<!-- x -->', repeat('y', cast(page_id % 100 AS INT)), '12', '卷一', '1947）。某')"
_SHAPES_SQL = _SHAPES.replace("array(", "[", 1)[:-1] + "]"
_SHAPE_ROWS = f"(SELECT page_id, unnest({_SHAPES_SQL}) AS line FROM pages)"


@query("d03_looks_like_title", f"SELECT page_id, line, {O.title_sql('line')} AS title FROM {_SHAPE_ROWS}")
def d03(t):
    rows = t("pages").select("page_id", F.explode(F.expr(_SHAPES)).alias("line"))
    return rows.select("page_id", "line", O.looks_like_title(F.col("line")).alias("title"))


@query("d04_normalize_title", f"SELECT page_id, {O.normalize_sql('line')} AS title FROM {_SHAPE_ROWS}")
def d04(t):
    return t("pages").select("page_id", F.explode(F.expr(_SHAPES)).alias("line")).select("page_id", O.normalize_title(F.col("line")).alias("title"))


@query("d05_title_level", f"SELECT page_id, line, coalesce({O.level_sql('line')}, 0) AS level FROM {_SHAPE_ROWS}")
def d05(t):
    rows = t("pages").select("page_id", F.explode(F.expr(_SHAPES)).alias("line"))
    return rows.select("page_id", "line", F.coalesce(O.level(F.col("line")), F.lit(0)).alias("level"))


#: A book: preface, contents with repeats, prose, body headings.
_BOOK = "concat('Some book', '\n', CASE WHEN page_id % 3 = 0 THEN 'no marker' ELSE 'Contents' END, '\n第一章 开端\n1.1 First steps\nPlain title\n第一章 开端\n', CASE WHEN page_id % 2 = 0 THEN 'Prose begins here，' ELSE repeat('z', 90) END, '\n\nANNEX ', page_id, '\n\n第', page_id % 9 + 1, '节 细节\nBIG WORDS\nx.\n2.3 Late one\n')"
_BOOKS = f"(SELECT page_id, {_BOOK} AS text FROM pages)"
_LINES_SQL = rf"(SELECT page_id, (i - 1)::INT AS pos, regexp_replace(c[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT page_id, string_split(text, chr(10)) AS c FROM {_BOOKS})))"
_MARK = ", ".join(f"'{m}'" for m in O.MARKERS)
_TOC = f"""
(SELECT page_id, pos, coalesce({O.level_sql('title')}, 1) AS level, title FROM (
  SELECT *, {O.normalize_sql('line')} AS title FROM (
    SELECT *, max(CASE WHEN length(line) > 80 OR regexp_matches(line, '{O.STOP}') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS stopped
    FROM (SELECT *, min(CASE WHEN lower(line) IN ({_MARK}) THEN pos END) OVER (PARTITION BY page_id) AS marker FROM {_LINES_SQL}) WHERE pos > marker)
  WHERE stopped = 0 AND {O.title_sql('line')}) QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY pos) = 1)"""
_BODY = f"""
(SELECT page_id, pos, level, title FROM (
  SELECT *, coalesce({O.level_sql('title')}, CASE WHEN regexp_matches(title, '{O.CAPS.replace(chr(39), chr(39) * 2)}') AND coalesce(above, '') = '' AND coalesce(below, '') = '' THEN 1 END)::INT AS level FROM (
    SELECT *, {O.normalize_sql('line')} AS title FROM (
      SELECT *, lag(line) OVER (PARTITION BY page_id ORDER BY pos) AS above, lead(line) OVER (PARTITION BY page_id ORDER BY pos) AS below FROM {_LINES_SQL}) WHERE {O.title_sql('line')}))
  WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY pos) = 1)"""
_PLAIN = f"(SELECT page_id, pos, level, title FROM (SELECT *, min(how) OVER (PARTITION BY page_id) AS h FROM (SELECT *, 0 AS how FROM {_TOC} UNION ALL SELECT *, 1 AS how FROM {_BODY})) WHERE how = h)"


def _books(t):
    return t("pages").select("page_id", F.expr(_BOOK.replace("\n", "\\n")).alias("text"))


@query("d06_toc_block", f"SELECT * FROM {_TOC}")
def d06(t):
    return O.toc_block(_books(t), "page_id")


@query("d07_body_headings", f"SELECT * FROM {_BODY}")
def d07(t):
    return O.body_headings(_books(t), "page_id")


@query("d08_plain_chapters", f"SELECT * FROM {_PLAIN}")
def d08(t):
    return O.plain_chapters(_books(t), "page_id")


@query("d09_d11_digest", f"""
SELECT p.page_id, coalesce('# 目录' || chr(10) || chr(10) || string_agg(repeat('  ', greatest(level - 1, 0)) || repeat('#', level) || ' ' || title, chr(10) ORDER BY pos), p.page_id::VARCHAR) AS digest, count(title) AS n
FROM pages p LEFT JOIN {_PLAIN} c ON c.page_id = p.page_id GROUP BY p.page_id""")
def d09(t):
    rows = O.digests(_books(t), "page_id")
    return rows.select("page_id", "digest", F.size(F.from_json("chapters", "array<struct<level:int,title:string>>")).cast("long").alias("n"))


@query("d10_find_chapters", f"SELECT page_id, title FROM {_PLAIN} WHERE contains(lower(title), 'late')")
def d10(t):
    rows = O.plain_chapters(_books(t), "page_id").groupBy("page_id").agg(F.array_agg(F.struct("level", "title")).alias("c"))
    return rows.select("page_id", F.explode(O.find_by_title(F.col("c"), F.lit("LATE"))).alias("c")).select("page_id", "c.title")


_DIGEST = "CASE page_id % 4 WHEN 0 THEN '# 目录\n\n' WHEN 1 THEN '# 目录\n\n## a' WHEN 2 THEN 'x\n# 章节摘要\ny' ELSE url END"


@query("d12_stale_digest", f"SELECT page_id, contains(d, '# 章节摘要') OR (contains(d, '# 目录') AND trim(regexp_extract(d, '(?s)# 目录(.*)$', 1), chr(10)) = '') AS stale FROM (SELECT page_id, {_DIGEST} AS d FROM pages)")
def d12(t):
    return t("pages").select("page_id", O.is_stale(F.expr(_DIGEST.replace("\n", "\\n"))).alias("stale"))


@query("d13_missing_digests", f"""
SELECT c.page_id FROM pages c LEFT JOIN (SELECT page_id, {_DIGEST} AS d FROM pages WHERE page_id % 5 <> 0) k USING (page_id)
WHERE d IS NULL OR contains(d, '# 章节摘要') OR (contains(d, '# 目录') AND trim(regexp_extract(d, '(?s)# 目录(.*)$', 1), chr(10)) = '')""")
def d13(t):
    known = t("pages").where("page_id % 5 <> 0").select(F.col("page_id").alias("doc_name"), F.expr(_DIGEST.replace("\n", "\\n")).alias("digest"))
    cache = t("pages").select(F.col("page_id").alias("doc_name"))
    return sync.missing_digests(cache, known, O.is_stale(F.col("_d"))).select(F.col("doc_name").alias("page_id"))


@query("d14_find_document", "SELECT doc_name FROM (SELECT DISTINCT 'Dir/' || source AS doc_name FROM documents) WHERE lower(doc_name) = 'src1' OR regexp_extract(lower(doc_name), '([^/]*)$', 1) = 'src1' OR contains(lower(doc_name), 'src1') OR contains('src1', lower(doc_name)) ORDER BY CASE WHEN lower(doc_name) = 'src1' OR regexp_extract(lower(doc_name), '([^/]*)$', 1) = 'src1' THEN 0 ELSE 1 END, doc_name LIMIT 1")
def d14(t):
    return sync.find_document(t("documents").select(F.concat(F.lit("Dir/"), "source").alias("doc_name")).distinct(), "SRC1")


@query("d15_list_documents", "SELECT DISTINCT source AS doc_name FROM documents WHERE source <> ''")
def d15(t):
    return t("documents").where("source <> ''").select(F.col("source").alias("doc_name")).distinct().orderBy("doc_name")

