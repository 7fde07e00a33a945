"""Substring deduplication with suffix automata of reference shards.

Documents are streamed through the automaton of their shard for matching
statistics (the longest suffix of the words read so far that the reference
holds); runs where it reaches the threshold are removed.  A reference given as
a table is cut into shards of bounded size, each broadcast in turn.  Against
the corpus itself the reference grows with the input, so the shards go only to
the documents that share an anchor with them; see ``repeats`` for the rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from . import words as W

LEAST = 50


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = nexts[last].get(c)
            if q is not None:  # known from another sequence
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, c, q)
                continue
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = new
            p = link[p]
        return new

    def statistics(self, words: list[int]) -> list[int]:
        """For each position the length of the longest match that ends there."""
        nexts, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for c in words:
            to = nexts[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nexts[state].get(c)
            if to is not None:
                state = to
                n += 1
            out.append(n)
        return out


def covered(stats: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a match of ``least`` words or more."""
    edge = np.zeros(len(stats) + 1, np.int64)
    end = np.flatnonzero(stats >= least)
    np.add.at(edge, end + 1, -1)
    np.add.at(edge, end + 1 - stats[end], 1)
    return np.cumsum(edge)[:-1] > 0


def match(rows: list[tuple[int, int, np.ndarray]], least: int) -> list[tuple[int, int, int]]:
    """Stream each document against the automaton of the earlier ones, then add what it has of its own."""
    auto, found = Automaton(), []
    known: set[bytes] = set()
    a = 0
    while a < len(rows):
        b = a
        while b < len(rows) and rows[b][0] == rows[a][0]:
            b += 1
        fresh = []
        for doc, start, words in rows[a:b]:
            key = words.tobytes()
            if key in known:  # the region as a whole is in an earlier document
                found.append((doc, start, start + len(words)))
                continue
            seq = words.tolist()
            if a:
                stats = np.array(auto.statistics(seq))
                found += [(doc, start + x, start + y) for x, y in repeats.runs_of(covered(stats, least))]
                if stats[-1] == len(seq):
                    continue
            fresh.append((key, seq))
        for key, seq in fresh:
            if len(seq) >= least:
                known.add(key)
            auto.add(seq)
        a = b
    return found


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start_word, n_words) of the passages that an earlier document has."""
    return repeats.compare(docs, least, match)


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    return repeats.remove(docs, repeated(docs, least))


def against(docs: DataFrame, reference: DataFrame, least: int, column: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, start_word, n_words) of the passages that ``reference`` has: one broadcast automaton a shard, one pass over ``docs`` each.

    For references that are small beside the documents, as benchmarks are.
    """
    spark = docs.sparkSession
    bins = reference.where(F.col(column).isNotNull()).select(F.col(column).alias("t"), F.length(column).cast("long").alias("n"))
    total = bins.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = int(total // shard_bytes) + 1
    parts = []
    for k in range(shards):
        texts = bins.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == k).select("t").toArrow()["t"]
        data, off = W.buffers(texts)
        s, e, wo = W.spans(data, off)
        h = W.hashes(data, s, e).view(np.int64)
        shared = spark.sparkContext.broadcast([h[wo[i] : wo[i + 1]] for i in range(len(off) - 1) if wo[i + 1] - wo[i] >= least])

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = Automaton()
            for seq in shared.value:
                auto.add(seq.tolist())
            for batch in batches:
                data, off = W.buffers(batch["text"])
                ids, out = batch["doc_id"].to_pylist(), []
                for x, y in W.slices(off):
                    s, e, wo = W.spans(data[off[x] : off[y]], off[x : y + 1] - off[x])
                    h = W.hashes(data[off[x] : off[y]], s, e).view(np.int64)
                    for i in range(x, y):
                        stats = np.array(auto.statistics(h[wo[i - x] : wo[i - x + 1]].tolist()), np.int64)
                        out += [(ids[i], p, q - p) for p, q in repeats.runs_of(covered(stats, least))]
                if out:
                    d, p, q = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(q, pa.int32())], ["doc_id", "start_word", "n_words"])

        parts.append(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(apply, "doc_id long, start_word int, n_words int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
