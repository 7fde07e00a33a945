"""Vectorised word and n-gram hashing over Arrow string columns.

Texts are handled as UTF-8 bytes: one pass finds the word borders, one running
sum gives the polynomial hash of every word.  Nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = U64(0x9E3779B97F4A7C15)
_B_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = [np.ones(1, U64), np.ones(1, U64)]
PIECE = 1 << 21
#: Bytes hashed at a time; their running sums stay in the processor's cache.
CHUNK = 1 << 15

#: Word separators: the ASCII blanks that ``\s`` means to RE2 and Java alike.
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 12, 13, 32]] = True
#: All ASCII but letters and digits, for folded words.
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = NON_WORD[128:] = False
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_BYTE = mix64(np.arange(1, 257, dtype=U64))
_STEP = mix64(np.arange(1001, 1129, dtype=U64)) | U64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, min(2 * len(_POW[0]), PIECE + (1 << 16)))
        for k, base in enumerate((_B, _B_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(wide)
    if texts.null_count:
        texts = texts.fill_null(b"" if wide == pa.large_binary() else "")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes together; a longer document is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word and the word offsets of the documents."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    word = ~sep[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes wherever they stand."""
    out = np.empty(len(starts), U64)
    a = 0
    table = _BYTE[fold]
    run = np.zeros(CHUNK + 1, U64)
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        lo, hi = starts[a], ends[b - 1]
        p, inv = _powers(int(hi - lo) + 1)
        if len(run) <= hi - lo:
            run = np.zeros(hi - lo + 1, U64)
        h = table[data[lo:hi]]
        h *= p[: hi - lo]
        np.cumsum(h, out=run[1 : hi - lo + 1])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        h = run[e]
        h -= run[s]
        h *= inv[s]
        h += (e - s).astype(U64)
        out[a:b] = mix64(h)
        a = b
    return out


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position and the offsets per document (none in documents of under n words)."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out[1:])
    if len(words) < n:
        return np.zeros(0, U64), out
    h = words[: len(words) - n + 1] * _STEP[0]
    for k in range(1, n):
        h += words[k : len(words) - n + 1 + k] * _STEP[k % len(_STEP)] * U64(2 * k + 1)
    keep = np.repeat(offsets[:-1], counts) + (np.arange(out[-1]) - np.repeat(out[:-1], counts))
    return mix64(h[keep]), out


def each(total: np.ndarray) -> np.ndarray:
    """Index of the document of every element, from offsets."""
    return np.repeat(np.arange(len(total) - 1), np.diff(total))


def to_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
