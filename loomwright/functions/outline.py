"""Document outlines: headings of Markdown and of plain text, tables of contents, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip

NUM = "〇零千百十九八七六五四三二一"
SECTION = rf"^(第\s*)?([{NUM}]+|[0-9]+)\s*节([\s:：]+.+)?$"
CHAPTER = rf"^(第\s*)?([{NUM}]+|[0-9]+)\s*[部篇卷章]([\s:：]+.+)?$"
NUMBERED = r"^([0-9]+([.][0-9]+){0,3})[）)、.\s]\s*\S"
CAPS = r"^[A-Z][-A-Z0-9,.:&'/() ]{3,}$"
LINK = r"^\[(.+)\][(]#[^)]*[)]$"
MARKERS = tuple("table of contents|contents|目錄|目 录|目录".split("|"))
NOISE = tuple("img|isbn|references and citations|references|copyright|all right reserved|all rights reserved".split("|"))
MARKER_TITLES = tuple("目錄|目 錄|目录|目 录".split("|"))
_PAGE = "[0-9]{1,4}"
_BAR = r"\s*[-|~/—～／→]\s*"
REJECT = (
    r"^\s*<!--.*-->\s*$",
    r"[?!:;,.？！：；，。]$",
    r"^(19|20)[0-9]{2}\s*[.、）)年]",
    rf"^.{{2,40}}?{_BAR}{_PAGE}$",
    rf"^(第[0-9{NUM}]+[节部篇卷章]|[a-zA-Z][-a-zA-Z0-9,.:&'/() ]{{2,40}}?)\s+{_PAGE}$",
    rf"^{_PAGE}{_BAR}\S.{{0,38}}$",
    rf"^[{NUM}]{{1,3}}[部篇卷章]$",
)
STOP = r"[?!;,．？！：；，。]$"
PREFACE = "前言"
CHAPTERS = "array<struct<level:int,title:string,text:string>>"


def split_lines(text: Column) -> Column:
    """D02."""
    return F.transform(F.split(text, r"\r\n|\r|\n", -1), strip)


def looks_like_title(line: Column) -> Column:
    """D03."""
    ok = (F.length(line) >= 2) & (F.length(line) <= 80) & ~F.lower(line).isin(*NOISE) & ~line.isin(*MARKER_TITLES)
    for p in REJECT:
        ok = ok & ~line.rlike(p)
    return ok


def title_sql(x: str) -> str:
    quoted = lambda xs: ", ".join("'" + s.replace("'", "''") + "'" for s in xs)
    rejects = " AND ".join(f"NOT regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in REJECT)
    return f"(length({x}) BETWEEN 2 AND 80 AND lower({x}) NOT IN ({quoted(NOISE)}) AND {x} NOT IN ({quoted(MARKER_TITLES)}) AND {rejects})"


def normalize_title(line: Column) -> Column:
    """D04."""
    s = strip(line)
    bare = F.when(s.rlike(LINK), strip(F.regexp_extract(s, LINK, 1))).otherwise(s)
    return F.regexp_replace(bare, r"\s+", " ")


def normalize_sql(x: str) -> str:
    s = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    inner = rf"regexp_replace(regexp_extract({s}, '{LINK}', 1), '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace(CASE WHEN regexp_matches({s}, '{LINK}') THEN {inner} ELSE {s} END, '\s+', ' ', 'g')"


def level(title: Column) -> Column:
    """Null where the shape says nothing."""
    dots = F.length(F.regexp_replace(F.regexp_extract(title, NUMBERED, 1), r"[^.]", "")) + 1
    return F.when(title.rlike(SECTION), 2).when(title.rlike(CHAPTER), 1).when(title.rlike(NUMBERED), dots).cast("int")


def level_sql(t: str) -> str:
    return f"(CASE WHEN regexp_matches({t}, '{SECTION}') THEN 2 WHEN regexp_matches({t}, '{CHAPTER}') THEN 1 WHEN regexp_matches({t}, '{NUMBERED}') THEN length(regexp_replace(regexp_extract({t}, '{NUMBERED}', 1), '[^.]', '', 'g')) + 1 END)::INT"


def chapters(text: Column) -> Column:
    """Markdown headings with their bodies; text before the first is the preface, level 0."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6}[ \t]+[^\n]*)", -1)

    def one(p: Column, i: Column) -> Column:
        head = F.regexp_extract(p, r"^(#{1,6})[ \t]+[^\n]*", 1)
        title = strip(F.regexp_extract(p, r"^#{1,6}[ \t]+([^\n]*)", 1))
        body = strip(F.when(head == "", p).otherwise(F.regexp_replace(p, r"^#{1,6}[ \t]+[^\n]*", "")))
        return F.struct(F.length(head).alias("level"), F.when(head == "", F.lit(PREFACE)).otherwise(title).alias("title"), body.alias("text"))

    found = F.transform(parts, one)
    found = F.filter(found, lambda c: (c["level"] > 0) | (c["text"] != ""))
    return F.when(F.exists(found, lambda c: c["level"] > 0), found).otherwise(F.array().cast(CHAPTERS))


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))


def toc_block(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, level, title) of the lines after the first contents marker, up to the first that is prose."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = numbered_lines(docs, key, text)
    marked = lines.withColumn("marker", F.min(F.when(F.lower("line").isin(*MARKERS), F.col("pos"))).over(Window.partitionBy(key)))
    after = marked.where(F.col("pos") > F.col("marker"))
    stop = (F.length("line") > 80) | F.col("line").rlike(STOP)
    after = after.withColumn("stopped", F.max(stop.cast("int")).over(w)).where("stopped = 0")
    titles = after.where(looks_like_title(F.col("line"))).withColumn("title", normalize_title(F.col("line")))
    return _first_seen(titles, key).select(key, "pos", F.coalesce(level(F.col("title")), F.lit(1)).alias("level"), "title")


def body_headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Strong shapes anywhere, capitals only between blank lines."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = numbered_lines(docs, key, text).withColumns({"above": F.lag("line").over(w), "below": F.lead("line").over(w)})
    titles = lines.where(looks_like_title(F.col("line"))).withColumn("title", normalize_title(F.col("line"))).withColumn("level", level(F.col("title")))
    alone = (F.coalesce("above", F.lit("")) == "") & (F.coalesce("below", F.lit("")) == "")
    titles = titles.withColumn("level", F.coalesce("level", F.when(F.col("title").rlike(CAPS) & alone, 1))).where("level is not null")
    return _first_seen(titles, key).select(key, "pos", "level", "title")


def _first_seen(titles: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key, "title").orderBy("pos")
    return titles.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def plain_chapters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contents block where there is one with titles, else body headings."""
    toc = toc_block(docs, key, text).withColumn("how", F.lit(0))
    both = toc.unionByName(body_headings(docs, key, text).withColumn("how", F.lit(1)))
    return both.withColumn("_h", F.min("how").over(Window.partitionBy(key))).where("how = _h").drop("_h", "how")


def toc_line(lv: Column, title: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.greatest(lv - 1, F.lit(0))), F.repeat(F.lit("#"), lv), F.lit(" "), title)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, chapters JSON); headings first, plain titles else, the key where there are none."""
    heads = docs.select(F.col(key), F.posexplode(chapters(F.col(text))).alias("pos", "c")).select(key, "pos", "c.level", "c.title", F.lit(0).alias("how"))
    both = heads.unionByName(plain_chapters(docs, key, text).withColumn("how", F.lit(1)))
    both = both.withColumn("_h", F.min("how").over(Window.partitionBy(key))).where("how = _h")
    grouped = both.groupBy(key).agg(F.array_sort(F.array_agg(F.struct("pos", "level", "title"))).alias("t"))
    made = grouped.select(
        key,
        F.concat(F.lit("# 目录\n\n"), F.array_join(F.transform("t", lambda c: toc_line(c["level"], c["title"])), "\n")).alias("digest"),
        F.to_json(F.transform("t", lambda c: F.struct(c["level"].alias("level"), c["title"].alias("title")))).alias("chapters"),
    )
    return docs.select(key).join(made, key, "left").select(key, F.coalesce("digest", F.col(key).cast("string")).alias("digest"), F.coalesce("chapters", F.lit("[]")).alias("chapters"))


def find_by_title(found: Column, keyword: Column) -> Column:
    """Chapters whose title holds the keyword in any case; an empty one finds nothing."""
    return F.filter(found, lambda c: (keyword != "") & F.contains(F.lower(c["title"]), F.lower(keyword)))


def is_stale(digest: Column) -> Column:
    """An old summary section, or a contents heading with nothing below."""
    return digest.contains("# 章节摘要") | (digest.contains("# 目录") & (strip(F.substring_index(digest, "# 目录", -1)) == ""))
