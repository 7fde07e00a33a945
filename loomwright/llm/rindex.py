"""Substring deduplication with a run-length index of the repetitive part of the corpus.

The regions of a group form one text with a barrier after each.  Its
Burrows-Wheeler transform is kept as runs, with the suffix positions at run
ends sampled.  Each document is streamed backwards for matching statistics: a
step that the current run can't extend jumps to the nearer end of the next run
of that word, up or down, and the sample there gives a place of the match in
the text.  What a match of the threshold's length is worth is kept by text
position, run-length too: the first document in which its words stand.  See
``repeats`` for the rules on nulls, short texts and ties.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame

from . import repeats

LEAST = 50


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; equal ranks vanish as the barriers are all different."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(sorted_[1:] != sorted_[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2
        if k >= n:
            return order


class RunIndex:
    """Run-compressed transform of ``text`` (whole numbers, barriers below zero and unique)."""

    def __init__(self, text: np.ndarray):
        sa = suffix_array(text)
        n = self.n = len(text)
        bwt = text[sa - 1]
        edge = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        last = np.append(edge[1:], n) - 1
        self.run_start = edge.tolist()
        heads = bwt[edge]
        self.head = heads.tolist()
        self.first_sample, self.last_sample = sa[edge].tolist(), sa[last].tolist()
        # LF: of each run's first row; rows of a run follow each other
        order = np.argsort(heads, kind="stable")
        size = last - edge + 1
        to = np.empty(len(edge), np.int64)
        to[order] = np.concatenate([[0], np.cumsum(size[order])[:-1]])
        self.to = to.tolist()
        self.runs_of: dict[int, list[int]] = {}
        for r in order.tolist():
            self.runs_of.setdefault(self.head[r], []).append(r)
        self.text = text

    def _common(self, a: int, words: np.ndarray, b: int, most: int) -> int:
        """Length of the common beginning of the text at ``a`` and ``words`` at ``b``, up to ``most``."""
        done, step = 0, 16
        while done < most:
            k = min(step, most - done, self.n - a - done, len(words) - b - done)
            if k <= 0:
                break
            differ = np.flatnonzero(self.text[a + done : a + done + k] != words[b + done : b + done + k])
            if len(differ):
                return done + int(differ[0])
            done += k
            step *= 4
        return done

    def statistics(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the length of the longest match that begins there, and one place of it in the text."""
        m = len(words)
        length, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
        run_start, head, to, runs_of = self.run_start, self.head, self.to, self.runs_of
        row, at, n = 0, self.n, 0  # at: text position of the suffix in this row
        seq = words.tolist()
        for i in range(m - 1, -1, -1):
            c = seq[i]
            runs = runs_of.get(c)
            if runs is None:
                n, row, at = 0, 0, self.n
                continue
            r = bisect_right(run_start, row) - 1
            if head[r] != c or at == self.n:
                k = bisect_left(runs, r)
                best = (-1, 0, 0, 0)
                if k < len(runs):
                    x = self.first_sample[runs[k]]
                    best = (self._common(x, words, i + 1, n), runs[k], run_start[runs[k]], x)
                if k > 0:
                    x = self.last_sample[runs[k - 1]]
                    end = (run_start[runs[k - 1] + 1] if runs[k - 1] + 1 < len(run_start) else self.n) - 1
                    up = self._common(x, words, i + 1, n)
                    if up > best[0]:
                        best = (up, runs[k - 1], end, x)
                n, r, row, at = best
            row = to[r] + row - run_start[r]
            at -= 1
            n += 1
            length[i], place[i] = n, at
        return length, place


def first_holder(text: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, document) along the text: the first document that has the ``least`` words from there; -1 where a barrier is among them."""
    n = len(text)
    out = np.full(n, -1, np.int64)
    if n >= least:
        windows = np.lib.stride_tricks.sliding_window_view(text < 0, least)
        run = np.concatenate([[0], np.cumsum(text < 0)])
        ok = np.flatnonzero(run[least:] - run[:-least] == 0)
        del windows
        if len(ok):
            # names of the windows by doubling, exact
            _, name = np.unique(text, return_inverse=True)
            name, width = name.astype(np.int64), 1
            while width < least:
                step = min(width, least - width)
                m = len(name) - step
                _, name = np.unique(name[:m] * (n + 1) + name[step:], return_inverse=True)
                width += step
            least_doc = np.full(name.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least_doc, name[ok], doc[ok])
            out[ok] = least_doc[name[ok]]
    start = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    return start, out[start]


def match(rows: list[tuple[int, int, np.ndarray]], least: int) -> list[tuple[int, int, int]]:
    """Runs of words in matches of ``least`` words whose first holder is an earlier document."""
    if len({d for d, _, _ in rows}) < 2:
        return []
    _, code = np.unique(np.concatenate([w for _, _, w in rows]), return_inverse=True)
    size = np.array([len(w) for _, _, w in rows])
    ends = np.cumsum(size)
    parts, doc = [], []
    streams = np.split(code.astype(np.int64), ends[:-1])
    for k, s in enumerate(streams):
        parts += [s, np.array([-1 - k])]
        doc.append(np.full(len(s) + 1, rows[k][0]))
    text, doc = np.concatenate(parts), np.concatenate(doc)
    index = RunIndex(text)
    start, holder = first_holder(text, doc, least)
    found = []
    for (d, at, _), s in zip(rows, streams):
        length, place = index.statistics(s)
        long = np.flatnonzero(length >= least)
        early = long[holder[np.searchsorted(start, place[long], "right") - 1] < d]
        edge = np.zeros(len(s) + 1, np.int64)
        edge[early] += 1
        np.add.at(edge, early + least, -1)
        found += [(d, at + x, at + y) for x, y in repeats.runs_of(np.cumsum(edge)[:-1] > 0)]
    return found


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start_word, n_words) of the passages that an earlier document has."""
    return repeats.compare(docs, least, match)


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with those passages removed; their first holder keeps them."""
    return repeats.remove(docs, repeated(docs, least))
