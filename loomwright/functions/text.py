"""Text cleaning, Markdown normalisation and token estimates as Column expressions.

Every pattern is written for Java's and RE2's regular expressions alike, so the
same rule can be put into DuckDB SQL with :func:`rule_sql`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
#: The agent's wider class: ideographs, extension A, kana and symbols, full-width forms.
CJK_WIDE = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{30ff}\x{ff00}-\x{ffef}]"
EDGE = r"^\s+|\s+$"

#: Replacement rules in their order: name -> [(pattern, replacement)].
RULES: dict[str, list[tuple[str, str]]] = {
    "c01": [(rf"(?is)<{t}[^>]*>.*?</{t}>", " ") for t in ("script", "style", "noscript")],
    "c02": [(r"<!--[\s\S]*?-->", " ")],
    "c03": [(r"<[^>]+>", " ")],
    "c04": [(r"&[a-zA-Z]+;", " "), (r"&#\d+;", " "), (r"&#x[0-9a-fA-F]+;", " ")],
    "c05": [(r"https?://\S+", " ")],
    "c06": [(r"\S+@\S+\.\S+", " ")],
    "c07": [(r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]", " ")],
    "c08": [(r"[\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", " ")],
    "c09": [(r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]", "")],
    "c10": [(r"[ \t]+", " ")],
}
NOT_ALNUM = r"[^\p{L}\p{N}\s]"
PAGE_LINES = (r"^\d{1,4}$", r"^第\s*[0-9]{1,4}\s*页$", r"(?i)^page\s+\d{1,4}$")
SEPARATOR_LINE = r"^[\-=_*#~]{3,}\s*$"


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, also where ``f`` is a lambda that runs for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def apply_rule(c: Column, name: str) -> Column:
    for pattern, new in RULES[name]:
        c = F.regexp_replace(c, pattern, new)
    return c


def rule_sql(expr: str, name: str) -> str:
    for pattern, new in RULES[name]:
        expr = f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"
    return expr


def is_noise(line: Column) -> Column:
    """Short lines that are mostly marks, page numbers, separators."""
    rest = F.length(F.regexp_replace(line, NOT_ALNUM, ""))
    garbage = (rest / F.greatest(F.length(line), F.lit(1)) < 0.3) & (F.length(line) < 20)
    out = garbage | line.rlike(SEPARATOR_LINE)
    for p in PAGE_LINES:
        out = out | line.rlike(p)
    return out & (F.length(line) > 0)


def clean_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda x: ~is_noise(x)), "\n")


def clean_text(c: Column) -> Column:
    """C01-C14, in order."""
    for name in RULES:
        c = apply_rule(c, name)
    return strip(F.regexp_replace(clean_lines(c), "\n{3,}", "\n\n"))


def lines_sql(expr: str) -> str:
    """C11-C14 of an expression in DuckDB."""
    line = r"regexp_replace(l, '^\s+|\s+$', '', 'g')"
    noise = " OR ".join([rf"(length(regexp_replace(s, '{NOT_ALNUM}', '', 'g')) / greatest(length(s), 1) < 0.3 AND length(s) < 20)", *(f"regexp_matches(s, '{p}')" for p in (SEPARATOR_LINE, *PAGE_LINES))])
    kept = f"list_filter(list_transform(string_split({expr}, chr(10)), lambda l: {line}), lambda s: s = '' OR NOT ({noise}))"
    return rf"regexp_replace(regexp_replace(array_to_string({kept}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def clean_sql(expr: str) -> str:
    for name in RULES:
        expr = rule_sql(expr, name)
    return lines_sql(expr)


def normalize_markdown(c: Column) -> Column:
    """Outside fences lines are stripped and blank runs become one; inside, lines stay as they are.

    A fold over the lines keeps (inside a fence, last was blank, text so far).
    """
    start = F.struct(F.lit(False).alias("code"), F.lit(True).alias("blank"), F.lit("").alias("out"))

    def step(a: Column, line: Column) -> Column:
        s = strip(line)
        fence = s.startswith("```")
        put = F.when(fence, s).when(a["code"], line).when(s != "", s).otherwise(F.lit(""))
        skip = ~fence & ~a["code"] & (s == "") & a["blank"]
        return F.struct(
            F.when(fence, ~a["code"]).otherwise(a["code"]).alias("code"),
            F.when(fence | a["code"] | (s != ""), F.lit(False)).otherwise(F.lit(True)).alias("blank"),
            F.when(skip, a["out"]).otherwise(F.concat(a["out"], put, F.lit("\n"))).alias("out"),
        )

    return F.regexp_replace(F.aggregate(F.split(c, "\n", -1), start, step)["out"], r"\s+$", "")


def markdown_sql(expr: str) -> str:
    """C15 where no line opens a fence."""
    lines = rf"list_transform(string_split({expr}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g'))"
    return rf"regexp_replace(regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def web_text(c: Column, limit: int = 20_000) -> Column:
    """Trimmed lines that aren't blank, cut to ``limit`` characters."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")
    return F.substring(F.array_join(lines, "\n"), 1, limit)


def strip_tags(c: Column) -> Column:
    """Tags become blanks, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def safe_name(path: Column) -> Column:
    """C17: 32 safe characters of the base name and 12 digits of the path's md5."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}._-]", ""), 1, 32), F.lit("_"), F.substring(F.md5(path), 1, 12))


def estimate_tokens(c: Column) -> Column:
    """Half the ideographs plus a third of the rest, each rounded down."""
    cjk = F.regexp_count(c, F.lit(CJK))
    return (F.floor(cjk / 2) + F.floor((F.length(c) - cjk) / 3)).cast("int")


def token_count(c: Column) -> Column:
    """K02."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(estimate_tokens(c), F.lit(1)))


def agent_tokens(c: Column) -> Column:
    """The conversation's estimate; 0 for an empty text."""
    cjk = F.regexp_count(c, F.lit(CJK_WIDE))
    mixed = F.greatest(F.lit(1), (cjk / 1.5 + (F.length(c) - cjk) / 4.0).cast("int"))
    plain = F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(c.rlike(r"^[\x{00}-\x{7f}]*$"), plain).otherwise(mixed)


def tokens_sql(expr: str) -> str:
    cjk = f"len(regexp_extract_all({expr}, '{CJK}'))"
    return f"(({cjk} // 2) + ((length({expr}) - {cjk}) // 3))::INT"


def agent_tokens_sql(expr: str) -> str:
    cjk = f"len(regexp_extract_all({expr}, '{CJK_WIDE}'))"
    return f"(CASE WHEN coalesce(length({expr}), 0) = 0 THEN 0 WHEN regexp_full_match({expr}, '[\\x{{00}}-\\x{{7f}}]*') THEN greatest(1, length({expr}) // 4) ELSE greatest(1, trunc({cjk} / 1.5 + (length({expr}) - {cjk}) / 4.0)) END)::INT"


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
