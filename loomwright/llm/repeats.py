"""Regions of documents that can hold a passage which another document has too.

Shared by the two substring deduplications.  A passage is ``least`` or more
consecutive words, compared byte for byte, blanks apart.  Anchors are the
smallest hashes of ``SEED``-word windows in every run of ``least - SEED + 1``
windows, so two documents that share a passage share an anchor of it.  Only
documents with an anchor that an earlier document has are compared, within the
group of that anchor's first document (its owner), so every pair of documents
that share a passage meets in a group.  A group with more than ``GROUP`` regions
(a passage that very many documents hold) is settled by the hashes of all its
windows of ``least`` words, one row each, so no task gathers it.

Cases: null and empty texts have no words; ties of hashes take the rightmost
window; documents that repeat a passage only within themselves are not
repeats; of documents with the same id and text one counts as the first; texts
are read whole, however long; extra columns are not read, but kept by
:func:`remove`; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from . import words as W

SEED = 24
#: Regions of an owner's group up to which they are compared in one task; larger groups are settled by the hashes of their windows.
GROUP = 4096
#: Words of regions that are sent on together.
SENT = 1 << 17


def anchors(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``h``) and documents of the minima of every ``window`` consecutive hashes within a document.

    Documents with fewer hashes than ``window`` have none.
    """
    n = len(h)
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e
    # sliding minimum by doubling; the position is packed into the low bits of a copy of the hash
    bits = max(1, int(n).bit_length())
    key = (h >> W.U64(bits) << W.U64(bits)) | (W.U64((1 << bits) - 1) - np.arange(n, dtype=np.uint64))
    low, width = key, 1
    while 2 * width <= window:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = window - width
    low = np.minimum(low[: n - window + 1], low[rest : rest + n - window + 1])
    doc = W.each(offsets)
    inside = doc[: n - window + 1] == doc[window - 1 :]
    pos = np.unique((W.U64((1 << bits) - 1) - (low[inside] & W.U64((1 << bits) - 1))).astype(np.int64))
    return pos, doc[pos]


def seeds(docs: DataFrame, least: int) -> DataFrame:
    """(seed, doc_id, at): hash, document and word position of every anchor."""
    window = least - SEED + 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.buffers(batch["text"])
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for a, b in W.slices(off):
                lo = off[a]
                s, e, wo = W.spans(data[lo : off[b]], off[a : b + 1] - lo)
                g, go = W.ngrams(W.hashes(data[lo : off[b]], s, e), wo, SEED)
                pos, doc = anchors(g, go, window)
                yield pa.RecordBatch.from_arrays([W.to_long(g[pos]), pa.array(ids[a + doc]), pa.array((pos - go[doc]).astype(np.int32))], ["seed", "doc_id", "at"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(apply, "seed long, doc_id long, at int")


def regions(docs: DataFrame, least: int) -> DataFrame:
    """(owner, doc_id, start, words): word hashes of the regions to compare, a row for each (owner, document, region).

    A region is what lies within reach of the owner's own anchors, as every
    window of ``least`` words has an anchor: a text full of passages isn't copied whole to each owner.
    """
    reach = least - SEED
    pool = shared(docs, least).groupBy("doc_id").agg(F.array_sort(F.array_agg(F.struct("at", "owner"))).alias("marks"))
    hit = docs.select("doc_id", "text").join(pool.select("doc_id", F.col("marks.at").alias("at"), F.col("marks.owner").alias("owners")).hint("merge"), "doc_id")

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        o, d, p, body = zip(*rows)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.int32)), pa.array(np.concatenate(body)))
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int32()), lists], ["owner", "doc_id", "start", "words"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.buffers(batch["text"])
            ids, owners, ats = batch["doc_id"].to_pylist(), batch["owners"], batch["at"]
            for a, b in W.slices(off):
                lo = off[a]
                s, e, wo = W.spans(data[lo : off[b]], off[a : b + 1] - lo)
                h = W.hashes(data[lo : off[b]], s, e)
                out: list[tuple] = []
                total = 0
                for k in range(a, b):
                    at, own = ats[k].values.to_numpy(), owners[k].values.to_numpy()
                    order = np.lexsort((at, own))
                    at, own = at[order], own[order]
                    n = int(wo[k - a + 1] - wo[k - a])
                    left, right = np.maximum(at - reach, 0), np.minimum(at + SEED + reach, n)
                    cut = np.flatnonzero((own[1:] != own[:-1]) | (left[1:] > right[:-1])) + 1
                    for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
                        p, q = int(left[x]), int(right[y - 1])
                        out.append((int(own[x]), ids[k], p, h[wo[k - a] + p : wo[k - a] + q].view(np.int64)))
                        total += q - p
                        if total > SENT:
                            yield sent(out)
                            out, total = [], 0
                if out:
                    yield sent(out)

    return hit.mapInArrow(apply, "owner long, doc_id long, start int, words array<long>")


def shared(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, owner, at) of the anchors that stand in two documents or more; the owner is the first of them."""
    by = Window.partitionBy("seed")
    return (
        seeds(docs, least)
        .withColumns({"owner": F.min("doc_id").over(by), "last": F.max("doc_id").over(by)})
        .where("owner < last").select("doc_id", "owner", "at")
    )


def compare(docs: DataFrame, least: int, match: Callable[[list[tuple[int, int, np.ndarray]], int], list[tuple[int, int, int]]]) -> DataFrame:
    """(doc_id, start_word, n_words): the maximal runs of words that lie in passages of ``least`` words which an earlier document has.

    ``match`` gets the regions of one owner's group, by document and position,
    and returns such runs.
    """
    if least <= SEED:
        raise ValueError(f"passages must be longer than {SEED} words")

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["doc_id"], pdf["start"], pdf["words"]), key=lambda r: r[:2])
        found = match([(int(d), int(s), np.asarray(w, np.int64)) for d, s, w in rows], least)
        return pd.DataFrame(found, columns=["doc_id", "a", "b"]).astype({"doc_id": "int64", "a": "int32", "b": "int32"})

    found = store.cut(regions(docs, least))
    large = found.groupBy("owner").count().where(F.col("count") > GROUP).select("owner")
    small = found.join(large.hint("merge"), "owner", "left_anti")
    runs = small.groupBy("owner").applyInPandas(group, "doc_id long, a int, b int").union(windows(found.join(large.hint("merge"), "owner", "left_semi"), least))
    # runs of one document from different groups are joined where they overlap or touch
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    return (
        runs.withColumn("before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("run", F.sum(F.when(F.col("before") >= F.col("a"), 0).otherwise(1)).over(w))
        .groupBy("doc_id", "run").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
        .select("doc_id", "start_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
    )


def windows(found: DataFrame, least: int) -> DataFrame:
    """(doc_id, a, b): the same for groups of any size, a row for each window; counts are taken before the exchange."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, words = batch["doc_id"].to_numpy(), batch["start"].to_numpy(), batch["words"]
            if not batch.num_rows:
                continue
            flat, off = words.flatten().to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
            for a, b in W.slices(off, W.PIECE // 8):
                g, go = W.ngrams(flat[off[a] : off[b]].view(np.uint64), off[a : b + 1] - off[a], least)
                doc = W.each(go)
                at = np.arange(len(g)) - go[doc] + start[a + doc]
                yield pa.RecordBatch.from_arrays([W.to_long(g), pa.array(ids[a + doc]), pa.array(at.astype(np.int32))], ["window", "doc_id", "a"])

    rows = found.select("doc_id", "start", "words").mapInArrow(explode, "window long, doc_id long, a int").distinct()
    first = rows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "first")
    hit = rows.join(first.hint("merge"), "window").where("first < doc_id").select("doc_id", "a")
    # neighbouring windows make a run
    at = Window.partitionBy("doc_id").orderBy("a")
    return hit.distinct().withColumn("run", F.col("a") - F.row_number().over(at)).groupBy("doc_id", "run").agg(F.min("a").alias("a"), (F.max("a") + least).cast("int").alias("b")).select("doc_id", "a", "b")


def runs_of(flag: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans``; texts without a span stay as they are, byte for byte.

    The blanks after a removed run go with it.  ``n_chars`` follows where it exists; a document of which nothing is left goes.
    """
    key, cut = store.fresh(docs, "cut_id", "cuts")
    lists = spans.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.array_agg(F.struct("start_word", "n_words"))).alias(cut))
    joined = docs.join(lists.hint("merge"), docs["doc_id"] == lists[key], "left").drop(key)
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch[cut].to_pylist()
            touched = np.array([c is not None for c in cuts], bool)
            if not touched.any():
                yield pa.RecordBatch.from_arrays([batch[c] for c in names], names)
                continue
            new = batch["text"].to_pylist()
            gone = np.zeros(len(new), bool)
            for i in np.flatnonzero(touched):
                data, off = W.buffers(batch["text"].slice(i, 1))
                s, e, _ = W.spans(data, off)
                keep, at = [], 0
                for c in cuts[i]:
                    x, y = c["start_word"], c["start_word"] + c["n_words"]
                    keep.append(data[at : s[x]])
                    at = s[y] if y < len(s) else len(data)
                keep.append(data[at:])
                new[i] = np.concatenate(keep).tobytes().decode("utf-8", "replace")
                gone[i] = not new[i].strip()
            text = pa.array(new, batch["text"].type)
            cols = {c: batch[c] for c in names} | {"text": text}
            if "n_chars" in cols:
                size = pa.compute.utf8_length(text).cast(batch["n_chars"].type)
                cols["n_chars"] = pa.compute.if_else(pa.array(touched), size, batch["n_chars"])
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names).filter(pa.array(~gone))

    return joined.mapInArrow(apply, docs.schema)
