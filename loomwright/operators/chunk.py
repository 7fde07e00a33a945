"""Chunking: by headings, by paragraphs, by similarity of sentences, recursively by separators.

Splits that need no memory are Column expressions; folds over the pieces are
``aggregate``; only the recursive splitter runs in Python, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CJK, estimate_tokens, let, strip
from ..functions.vectors import cosine

SIZE, OVERLAP, LEAST, SHARE = 800, 80, 100, 0.10
SEPARATORS = tuple("\n\n|\n|。|. | |".split("|"))
HEADING = r"(?m)(?=^#{1,6}\s+\S)"
BREAKS = ("\n", "。", ". ", " ")


def split_paragraphs(text: Column) -> Column:
    """K10 without a limit: non-blank paragraphs, stripped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), strip), lambda p: p != "")


def split_structure(text: Column) -> Column:
    """Sections that begin at headings; text before the first is one too; no heading: paragraphs."""
    cut = F.filter(F.transform(F.split(text, HEADING, -1), strip), lambda p: p != "")
    return F.when(text.rlike(r"(?m)^#{1,6}\s+\S"), cut).otherwise(split_paragraphs(text))


def _fold(parts: Column, join) -> Column:
    """Left-to-right packing with a blank line between: ``join(tokens of current, tokens of next)`` says whether next goes onto current.

    Ideographs and lengths are carried along, so no text is counted twice.
    """
    tokens = lambda wide, n: (F.floor(wide / 2) + F.floor((n - wide) / 3)).cast("int")
    counted = F.transform(parts, lambda p: F.struct(p.alias("t"), F.regexp_count(p, F.lit(CJK)).alias("w"), F.length(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("w"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        glue = a["cur"].isNotNull() & join(tokens(a["w"], a["n"]), tokens(p["w"], p["n"]))
        return let(glue, lambda g: F.struct(
            F.when(a["cur"].isNull() | g, a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))).alias("done"),
            F.when(g, F.concat(a["cur"], F.lit("\n\n"), p["t"])).otherwise(p["t"]).alias("cur"),
            F.when(g, a["w"] + p["w"]).otherwise(p["w"]).alias("w"),
            F.when(g, a["n"] + 2 + p["n"]).otherwise(p["n"]).alias("n"),
        ))

    return F.aggregate(counted, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def group_paragraphs(text: Column, most: int) -> Column:
    """K10 with a limit: paragraphs packed while their estimates stay within it; one paragraph is never cut."""
    return _fold(split_paragraphs(text), lambda cur, p: cur + p <= most)


def merge_small(chunks: Column, size: int = SIZE, least: int = LEAST) -> Column:
    """The next chunk goes onto one that is below ``least``, if both stay within ``size``."""
    return _fold(chunks, lambda cur, p: (cur < least) & (cur + p <= size))


def tail(text: Column, most: int) -> Column:
    """The last sentences within ``most`` tokens, one at least."""
    parts = F.filter(F.split(text, r"(?<=[。！？!?.])\s*|\n", -1), lambda p: strip(p) != "")
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(a: Column, p: Column) -> Column:
        n = a["n"] + estimate_tokens(p)
        full = a["full"] | ((n > most) & (a["t"] != ""))
        return F.struct(F.when(full, a["t"]).otherwise(F.concat(p, a["t"])).alias("t"), F.when(full, a["n"]).otherwise(n).alias("n"), full.alias("full"))

    return strip(F.aggregate(F.reverse(parts), start, step)["t"])


def overlap(chunks: Column, size: int = SIZE, share: float = SHARE, fixed: int = OVERLAP) -> Column:
    """Each chunk after the first begins with the tail of the one before it, as that was."""
    most = int(size * share) if share else fixed
    if most <= 0:
        return chunks

    def all_of(cs: Column) -> Column:
        def add(c: Column, i: Column) -> Column:
            return F.when(i == 0, c).otherwise(let(tail(F.get(cs, i - 1), most), lambda t: F.when(t == "", c).otherwise(F.concat(t, F.lit("\n\n"), c))))

        return F.transform(cs, add)

    return let(chunks, all_of)


def hybrid(text: Column, size: int = SIZE, least: int = LEAST, share: float = SHARE, fixed: int = OVERLAP) -> Column:
    """Sections, over-long ones by paragraphs, small ones merged, then overlap."""
    parts = F.flatten(F.transform(split_structure(text), lambda s: F.when(estimate_tokens(s) <= size, F.array(s)).otherwise(group_paragraphs(s, size))))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(overlap(merge_small(parts, size, least), size, share, fixed))


def chunk_documents(docs: DataFrame, chunks: Column, source: str = "source") -> DataFrame:
    """(source, chunk_index, text)."""
    return docs.select(F.col(source).alias("source"), F.posexplode(chunks).alias("chunk_index", "text"))


WIDE = re.compile("[\u4e00-\u9fff]")


def _wide(s: str) -> int:
    return 0 if s.isascii() else len(WIDE.findall(s))


def _tokens(wide: int, n: int) -> int:
    return wide // 2 + (n - wide) // 3


def _cost(s: str) -> int:
    return _tokens(_wide(s), len(s))


def _reach(text: str, at: int, step: int, full) -> int:
    """Characters from ``at`` in direction ``step`` until ``full(tokens)``."""
    wide = narrow = n = 0
    while 0 <= at + step * n - (step < 0) < len(text):
        c = text[at + step * n - (step < 0)]
        wide, narrow = (wide + 1, narrow) if "\u4e00" <= c <= "\u9fff" else (wide, narrow + 1)
        stop = full(wide // 2 + narrow // 3)
        if stop == "before":
            return n
        n += 1
        if stop:
            return n
    return n


def _back(text: str, end: int, back: int) -> int:
    """Characters before ``end`` until they have ``back`` tokens."""
    last = text[max(0, end - 3 * back) : end]
    return len(last) if back > 0 and not _wide(last) else _reach(text, end, -1, lambda n: n >= back)


def _ahead(text: str, at: int, size: int) -> int:
    """Characters from ``at`` within ``size`` tokens."""
    part = text[at : at + 3 * size + 2]
    return len(part) if size >= 0 and not _wide(text[at : at + 3 * size + 3]) else _reach(text, at, 1, lambda n: "before" if n > size else False)


def split_window(text: str, size: int, back: int) -> list[str]:
    """Windows within ``size``, cut after a natural break in their second half; repeats go, windows overlap by ``back``."""
    out: dict[str, None] = {}
    at = 0
    while at < len(text):
        end = at + _ahead(text, at, size)
        if end < len(text):
            middle = at + (end - at) // 2
            for mark in BREAKS:
                found = text.rfind(mark, at, end)
                if found > middle:
                    end = found + len(mark)
                    break
        piece = text[at:end].strip()
        if piece:
            out.setdefault(piece)
        if end >= len(text):
            break
        at = max(end - min(end - at, _back(text, end, back)), at + 1)
    return list(out)


def carry_over(chunks: list[str], back: int, sep: str) -> list[str]:
    """Each chunk begins with the last ``back`` tokens of the one before, itself carried over already."""
    if back <= 0:
        return chunks
    out = chunks[:1]
    for chunk in chunks[1:]:
        last = out[-1]
        if max(_cost(last), 1) > back:
            lead = last[len(last) - _back(last, len(last), back) :]
            out.append(lead + sep + chunk if lead.strip() else chunk)
        else:
            out.append(chunk)
    return out


def split_recursive(text: str, size: int = SIZE, back: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Greedy packing at the first separator that the text has; what is too long goes on to the next ones."""
    if max(_cost(text), 1 if text else 0) <= size:
        return [text] if text.strip() else []
    for k, sep in enumerate(separators):
        if sep == "":
            break
        if sep not in text:
            continue
        done: list[str] = []
        held, wide, between = "", 0, _wide(sep)
        for part in text.split(sep):
            more = _wide(part)
            if held and _tokens(wide + between + more, len(held) + len(sep) + len(part)) <= size:
                held += sep + part
                wide += between + more
                continue
            if held.strip():
                done.append(held)
            if _tokens(more, len(part)) <= size:
                held, wide = part, more
            else:
                done += split_recursive(part, size, back, separators[k + 1 :])
                held = ""
        if held.strip():
            done.append(held)
        if done:
            return carry_over(done, back, sep)
    return split_window(text, size, back)


def recursive(text: Column, size: int = SIZE, back: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """K03 over a column."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda t: split_recursive(t or "", size, back, separators))

    return run(text)


def strict(chunks: Column, size: int = SIZE, back: int = OVERLAP) -> Column:
    """Chunks (a stored column, not an expression: lambdas can't go into a Python UDF) of which those over ``size`` are cut by the window splitter, so that none exceeds it."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda cs: [p for c in cs for p in ([c] if _cost(c) <= size else split_window(c, size, back))])

    return run(chunks)


SENTENCE_END = r"(?<=\. |! |\? |\n|[。！？；，])"


def semantic(docs: DataFrame, key: str, text: str, embed, threshold: float = 0.7, least_chars: int = 20) -> DataFrame:
    """(key, chunk_index, text); a new chunk begins where neighbouring sentences are less alike than ``threshold``.

    Sentences are explored by a lag over their embeddings and a running sum of
    breaks.  Short sentences stay with the one before them, and a chunk has two
    sentences or more where another follows: of breaks in a row every second counts.
    """
    w = Window.partitionBy(key).orderBy("pos")
    parts = docs.select(F.col(key), F.posexplode(F.split(F.col(text), SENTENCE_END, -1)).alias("pos", "s")).where(strip(F.col("s")) != "")
    parts = parts.withColumn("e", embed(F.col("s"))).withColumn("before", F.lag("e").over(w))
    brk = F.col("before").isNotNull() & (F.length("s") >= least_chars) & (cosine(F.col("e"), F.col("before")) < threshold)
    parts = parts.withColumns({"n": F.row_number().over(w), "b": brk}).withColumn("b", F.col("b") | (F.col("n") == 1))
    row = Window.partitionBy(key, "b").orderBy("pos")
    parts = parts.withColumn("run", F.col("n") - F.row_number().over(row))
    nth = F.row_number().over(Window.partitionBy(key, "b", "run").orderBy("pos"))
    parts = parts.withColumn("cut", F.col("b") & (nth % 2 == 1) & (F.col("n") > 1)).withColumn("g", F.sum(F.col("cut").cast("int")).over(w))
    joined = parts.groupBy(key, "g").agg(F.array_sort(F.array_agg(F.struct("pos", "s"))).alias("p"))
    return joined.select(key, F.col("g").cast("int").alias("chunk_index"), strip(F.array_join(F.transform("p", lambda x: x["s"]), "")).alias("text"))


def semantic_chunks(docs: DataFrame, key: str, text: str, embed, size: int = SIZE, least: int = LEAST, share: float = SHARE, fixed: int = OVERLAP) -> DataFrame:
    """K11 whole: (key, chunks) by similarity of sentences, those over ``size`` cut, small ones merged, then overlap."""
    parts = semantic(docs, key, text, embed).groupBy(key).agg(F.array_sort(F.array_agg(F.struct("chunk_index", "text"))).alias("p"))
    fits = F.flatten(F.transform(F.transform("p", lambda x: x["text"]), lambda c: F.when(estimate_tokens(c) <= size, F.array(c)).otherwise(group_paragraphs(c, size))))
    return parts.select(key, overlap(merge_small(fits, size, least), size, share, fixed).alias("chunks"))


def with_fallback(docs: DataFrame, key: str, text: str, embed=None, size: int = SIZE) -> DataFrame:
    """K07's chain: (key, strategy, chunks) of the first of hybrid, semantic (with an embedder) and recursive that gives any; blank texts have none."""
    done = docs.select(F.col(key), F.col(text), hybrid(F.col(text), size).alias("chunks")).withColumn("strategy", F.lit("hybrid"))
    if embed is not None:
        more = semantic_chunks(docs, key, text, embed, size).withColumnRenamed("chunks", "_s")
        done = done.join(more, key, "left").withColumns({"strategy": F.when((F.size("chunks") > 0) | F.col("_s").isNull(), F.col("strategy")).otherwise("semantic"), "chunks": F.when((F.size("chunks") > 0) | F.col("_s").isNull(), F.col("chunks")).otherwise(F.col("_s"))})
    last = F.when(F.size("chunks") > 0, F.array().cast("array<string>")).otherwise(recursive(F.col(text), size))
    done = done.withColumn("_r", last)
    none = F.size("chunks") == 0
    return done.select(key, F.when(none, "recursive").otherwise(F.col("strategy")).alias("strategy"), F.when(none, F.col("_r")).otherwise(F.col("chunks")).alias("chunks"))


STRATEGIES = ("hybrid", "recursive", "paragraph")


def chunks_by(strategy: str, text: Column, size: int = SIZE) -> Column:
    """The splitter by name; blank texts have no chunks in any.  ``semantic`` needs rows, see :func:`semantic_chunks`."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")
    return {"hybrid": hybrid, "recursive": recursive, "paragraph": group_paragraphs}[strategy](text, size)
