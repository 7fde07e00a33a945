"""Byte-level BPE by replaying the merges over the distinct words of a shard of the corpus.

An inverted index leads from each token pair to the positions where it stands;
merges are applied in rank order, each to all its positions at once, and only
the neighbours of a merged pair are looked at again.  Every shard is a run of
whole documents of about ``SHARD`` bytes, so no shuffle is needed.

Cases: a null text gives null ids, an empty one an empty list; the strings of
special tokens are ordinary text; repeated rows are encoded alike; bytes that
are no UTF-8 can't occur in a string column.  Other columns pass through; those
called like a column of the result are replaced by it.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SHARD = 2 << 20
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = range(4)
_CACHE: dict[str, Merges] = {}


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        names[chr(256 + k)] = b
    return names


class Merges:
    """Vocabulary and ranked merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names, vocab = _byte_names(), model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for name, b in names.items():
            self.byte_id[b] = vocab[name]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        size = max(vocab.values()) + 1
        spelled = [b""] * size
        for text, i in vocab.items():
            spelled[i] = bytes(names[c] for c in text) if all(c in names for c in text) else text.encode()
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge of it."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.order[at], -1)


def merges(path: str) -> Merges:
    if path not in _CACHE:
        _CACHE[path] = Merges(path)
    return _CACHE[path]


def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for p in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(p))[0]
        if c == "L":
            table[p] = LETTER
        elif c == "N":
            table[p] = NUMBER
    table[_SPACES] = SPACE
    return table


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens, which tile the texts, and the document of each."""
    if "classes" not in globals():
        globals()["classes"] = _classes()
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
    doc_at = np.searchsorted(at, offsets)
    cls = classes[cp]  # noqa: F821
    cut = np.ones(len(cp), bool)
    cut[1:] = cls[1:] != cls[:-1]
    border = doc_at[:-1][np.diff(doc_at) > 0]
    cut[border] = True
    rs = np.flatnonzero(cut)
    end = np.append(rs[1:], len(cp))
    kind = cls[rs]
    first = np.zeros(len(cp) + 1, bool)
    first[border] = first[len(cp)] = True
    opens, closes = first[rs], first[end]  # the run begins, ends a document
    blank_end = (kind == SPACE) & (cp[end - 1] == 32) & ~closes
    attach = np.zeros(len(rs), bool)
    attach[1:] = blank_end[:-1] & ~opens[1:]
    space, size = kind == SPACE, end - rs
    start = np.zeros(len(cp), bool)
    start[(rs - attach)[~space]] = True
    start[rs[space & ((size >= 2) | closes | (cp[end - 1] != 32))]] = True
    start[(end - 1)[space & ~closes & (cp[end - 1] != 32)]] = True
    # contractions: an apostrophe of its own before letters
    r = np.flatnonzero((kind == OTHER) & (size == 1) & (cp[rs] == 39) & ~attach & ~closes)
    r = r[kind[r + 1] == LETTER]
    if len(r):
        s, stop = rs[r] + 1, end[r + 1]
        c1 = cp[s]
        c2 = np.where(stop - s >= 2, cp[np.minimum(s + 1, len(cp) - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "sdmt"])
        two = ~one & (((c1 == 108) & (c2 == 108)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 114) & (c2 == 101)))
        start[s[one | two]] = False
        after = np.where(one, s + 1, s + 2)
        start[after[(one | two) & (after < stop)]] = True
    tok = np.flatnonzero(start)
    return at[tok], np.searchsorted(doc_at, tok, "right") - 1


def replay(model: Merges, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of distinct words (bytes and offsets): all merges in rank order over the whole list."""
    n = len(offsets) - 1
    size = len(flat) + n + 1  # a barrier before each word and one at the end
    where = np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offsets)) + 1
    sym = np.full(size, -1, np.int64)
    sym[where] = model.byte_id[flat]
    nxt, prv = np.arange(1, size + 1), np.arange(-1, size - 1)
    nxt[-1], prv[0] = size - 1, 0
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(pos: np.ndarray, rank: np.ndarray) -> None:
        known = rank >= 0
        pos, rank = pos[known], rank[known]
        if not len(pos):
            return
        if len(pos) > 1:
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(pos)]
        else:
            bounds = [0, 1]
        for a, b in zip(bounds, bounds[1:]):
            k = int(rank[a])
            if k in index:
                index[k].append(pos[a:b])
            else:
                index[k] = [pos[a:b]]
                heapq.heappush(heap, k)

    pos = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
    add(pos, model.ranks(sym[pos], sym[pos + 1]))
    while heap:
        k = heapq.heappop(heap)
        lists = index.pop(k)
        pos = lists[0] if len(lists) == 1 and len(lists[0]) == 1 else np.unique(np.concatenate(lists))
        a, b, new = model.left[k], model.right[k], model.new[k]
        follow = nxt[pos]
        ok = (sym[pos] == a) & (sym[follow] == b)
        pos, follow = pos[ok], follow[ok]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:  # of overlapping pairs the leftmost goes first
            chain = np.zeros(len(pos), bool)
            chain[1:] = follow[:-1] == pos[1:]
            head = np.flatnonzero(~chain)
            nth = np.arange(len(pos)) - np.repeat(head, np.diff(np.append(head, len(pos))))
            pos, follow = pos[nth % 2 == 0], follow[nth % 2 == 0]
        far = nxt[follow]
        sym[pos] = new
        sym[follow] = -2
        nxt[pos] = far
        prv[far] = pos
        before = prv[pos]
        left, right = before[sym[before] >= 0], pos[sym[far] >= 0]
        both = np.concatenate([left, right])
        if len(both):
            add(both, model.ranks(sym[both], sym[nxt[both]]))
    alive = np.flatnonzero(sym >= 0)
    starts = offsets[:-1] + np.arange(n) + 1
    return sym[alive], np.append(np.searchsorted(alive, starts), len(alive))


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` one after another."""
    total = np.cumsum(size)
    at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - total + size, size)
    return flat[at]


def encode(model: Merges, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all documents and their offsets."""
    starts, doc = split(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ends = np.append(starts[1:], len(data))
    _, one, of = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends[one] - starts[one]
    word_off = np.concatenate([[0], np.cumsum(size)])
    ids, at = replay(model, gather(data, starts[one], size), word_off)
    count = np.diff(at)[of]
    tokens = np.bincount(doc, count, len(offsets) - 1).astype(np.int64)
    return gather(ids, at[:-1][of], count), np.concatenate([[0], np.cumsum(tokens)])


def decode(model: Merges, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents and their offsets."""
    size = model.length[ids]
    run = np.concatenate([[0], np.cumsum(size)])
    return gather(model.bytes, model.start[ids], size), run[offsets]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to about SHARD bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        off = W.buffers(batch["text"])[1]
        for a, b in W.slices(off, SHARD):
            held.append(batch.slice(a, b - a))
            size += int(off[b] - off[a])
            if size >= SHARD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        for b in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield b


def encode_documents(docs: DataFrame, path: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ``token_ids``, ``n_tokens`` and ``round_trip``: whether decoding the ids gave the text again."""
    docs = docs.drop("token_ids", "n_tokens", "round_trip")
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in kept]
    extra = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in _shards(batches):
            data, off = W.buffers(batch["text"])
            ids, at = encode(model, data, off)
            back, boff = decode(model, ids, at)
            if np.array_equal(boff, off) and np.array_equal(back, data):
                same = np.ones(len(batch), bool)
            else:
                same = np.array([np.array_equal(back[boff[i] : boff[i + 1]], data[off[i] : off[i + 1]]) for i in range(len(batch))])
            null = np.array(batch["text"].is_null())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), lists, pa.array(np.diff(at), mask=null), pa.array(same, mask=null)], [*names, *(f.name for f in extra)])

    return docs.mapInArrow(apply, T.StructType([*kept, *extra]))


def decode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``text`` from ``token_ids``; null ids give null."""
    rest = [c for c in docs.columns if c != "text"]
    src = docs.select(*rest)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            null = np.array(batch["token_ids"].is_null())
            lists = pa.array([v or [] for v in batch["token_ids"].to_pylist()], pa.list_(pa.int64()))
            data, off = decode(model, lists.values.to_numpy(), lists.offsets.to_numpy())
            raw = data.tobytes()
            text = [None if null[i] else raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*rest, "text"])

    return src.mapInArrow(apply, T.StructType([*src.schema.fields, T.StructField("text", T.StringType())]))
