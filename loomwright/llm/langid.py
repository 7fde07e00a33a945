"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Cases: null and empty texts, and texts with fewer than ``MIN_GRAMS`` letters,
get language ``und`` and are not accepted; languages tie by name; with no
labelled row every document is ``und``.  Other columns pass through; those
called like a column of the result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

ORDER = 4
BITS = 6  # letters beyond the 62 commonest of the training text share one symbol
MIN_GRAMS = 2
CHARS = 1 << 20


def _codes(texts: pa.Array, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every character (1 at the border of a word and of a document) and offsets."""
    parts = [" " + (t or "").lower() + " " for t in texts.to_pylist()]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return alphabet[np.minimum(points, len(alphabet) - 1)], off


def _grams(sym: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER-grams ending at each character but the first of a document; symbols before the document are border."""
    s = sym.astype(np.uint32)
    place = np.arange(len(s)) - np.repeat(off[:-1], np.diff(off))
    code = s.copy()
    for k in range(1, ORDER):
        prev = np.ones(len(s), np.uint32)
        prev[k:] = s[:-k] if k else s
        prev[place < k] = 1
        code |= prev << np.uint32(BITS * k)
    # a border after a border says nothing, nor does what is not a letter
    before = np.ones(len(s), np.uint32)
    before[1:] = s[:-1]
    before[place == 0] = 1
    use = (place > 0) & ~((s == 1) & (before == 1))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return code[use], doc[use]


def _kneser_ney(counts: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From counts of ORDER-grams: per order the sorted hashes, log probabilities and log back-off weights.

    The highest order uses counts, lower ones the number of distinct symbols
    before the gram; each order has the discount n1 / (n1 + 2 n2).
    """
    code, n = counts
    order = np.argsort(code)
    code, n = code[order].astype(np.uint64), n[order].astype(float)
    levels = []
    for m in range(ORDER, 0, -1):
        levels.append((code, n))
        code, n = np.unique(code & W.U64((1 << BITS * (m - 1)) - 1), return_counts=True)
        n = n.astype(float)
    levels.reverse()  # unigrams first
    base = 1.0 / (1 << BITS)
    tables, lower = [], None
    for m, (code, n) in enumerate(levels, 1):
        n1, n2 = (n == 1).sum(), (n == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx = code >> W.U64(BITS)
        keys, at = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(at, n), np.bincount(at)
        back = d * kinds / total
        if lower is None:
            under = np.full(len(code), base)
        else:
            lc, lp = lower
            under = lp[np.searchsorted(lc, code & W.U64((1 << BITS * (m - 1)) - 1))]
        p = np.maximum(n - d, 0) / total[at] + back[at] * under
        lower = (code, p)
        tables.append((code, np.log(p), keys, np.log(back)))
    hashes, logs, chash, cback = [], [], [], []
    for m, (code, lp, keys, lb) in enumerate(tables, 1):
        hashes.append(W.mix64(code * W.U64(8) + W.U64(m)))
        logs.append(lp)
        chash.append(W.mix64(keys * W.U64(8) + W.U64(m)))
        cback.append(lb)
    h, c = np.concatenate(hashes), np.concatenate(chash)
    i, j = np.argsort(h), np.argsort(c)
    return h[i], np.concatenate(logs)[i], c[j], np.concatenate(cback)[j]


def log_prob(model: tuple, code: np.ndarray) -> np.ndarray:
    """Interpolated log probability of the last symbol of each packed gram, given the ones before it."""
    h, logs, c, back = model
    code = code.astype(np.uint64)
    out = np.zeros(len(code))
    open_ = np.arange(len(code))
    for m in range(ORDER, 0, -1):
        if not len(open_):
            break
        part = code[open_] & W.U64((1 << BITS * m) - 1)
        key = W.mix64(part * W.U64(8) + W.U64(m))
        at = np.minimum(np.searchsorted(h, key), len(h) - 1)
        hit = h[at] == key
        out[open_[hit]] += logs[at[hit]]
        open_, part = open_[~hit], part[~hit]
        ctx = W.mix64((part >> W.U64(BITS)) * W.U64(8) + W.U64(m))
        at = np.minimum(np.searchsorted(c, ctx), len(c) - 1)
        seen = c[at] == ctx
        out[open_[seen]] += back[at[seen]]
    out[open_] += np.log(1.0 / (1 << BITS))
    return out


class Scorer:
    """Total log probability per language; each distinct gram is looked up in the sorted arrays once per worker."""

    def __init__(self, model: dict):
        self.model = model
        self.slot = np.full(1 << BITS * ORDER, -1, np.int32)
        self.rows = np.zeros((0, len(model["langs"])), np.float32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages) log probabilities and the number of grams of each document."""
        sym, off = _codes(texts, self.model["alphabet"])
        code, doc = _grams(sym, off)
        new = np.unique(code[self.slot[code] < 0])
        if len(new):
            self.slot[new] = len(self.rows) + np.arange(len(new))
            found = np.stack([log_prob(m, new) for m in self.model["tables"]], 1).astype(np.float32)
            self.rows = np.concatenate([self.rows, found])
        at = self.slot[code]
        n = len(off) - 1
        sums = np.stack([np.bincount(doc, self.rows[at, k], n) for k in range(self.rows.shape[1])], 1)
        return sums, np.bincount(doc, minlength=n)


def train(docs: DataFrame, sample: int = 400, reject: float = 4.0) -> dict | None:
    """Models from at most ``sample`` labelled documents per language (those of the lowest hashed ids).

    A fifth of them is held out: its cross-entropy under the right model sets
    the limit of acceptance, its mean plus ``reject`` deviations (at least 0.5
    and more for short texts, whose entropy scatters as 1 / sqrt(grams)).
    """
    from pyspark.sql import Window

    ids = docs.where("lang is not null and text is not null and length(text) > 200").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = ids.withColumn("n", rank).where(F.col("n") <= sample).select(F.col("doc_id").alias("d"), "n")
    got = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("d")).select("lang", "text", "n", "doc_id").toArrow().sort_by([("lang", "ascending"), ("n", "ascending")])
    if not len(got):
        return None
    langs = sorted(set(got["lang"].to_pylist()))
    everything = "".join(got["text"].to_pylist()).lower()
    points, n = np.unique(np.frombuffer(everything.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    letters = np.array([chr(p).isalpha() for p in points])
    top = points[letters][np.argsort(-n[letters], kind="stable")][: (1 << BITS) - 3]
    alphabet = np.ones(0x20000, np.uint8)
    rest = np.array([chr(p).isalpha() if not 0xD800 <= p < 0xE000 else False for p in range(len(alphabet))])
    alphabet[rest] = 2
    top = top[top < len(alphabet)]
    alphabet[top] = np.arange(3, 3 + len(top))
    tables, held = [], []
    for lang in langs:
        t = got.filter(pa.compute.equal(got["lang"], lang))
        test = np.arange(len(t)) % 5 == 4
        code, _ = _grams(*_codes(t.filter(pa.array(~test))["text"], alphabet))
        tables.append(_kneser_ney(np.unique(code, return_counts=True)))
        held.append(t.filter(pa.array(test)))
    model = {"langs": langs, "alphabet": alphabet, "tables": tables, "limit": [0.0] * len(langs), "spread": [1.0] * len(langs)}
    scorer = Scorer(model)
    for k, t in enumerate(held):
        if not len(t):
            model["limit"][k] = float("inf")
            continue
        sums, n = scorer(t["text"])
        right = sums.argmax(1) == k  # labels may be wrong
        n = np.maximum(n, 1)
        e = (-sums[:, k] / n)[right] if right.any() else -sums[:, k] / n
        n = n[right] if right.any() else n
        mid = float(np.median(e))
        model["limit"][k] = mid + max(0.5, reject * float(np.median(np.abs(e - mid))) * 1.5)
        model["spread"][k] = reject * float(np.median(np.abs(e - mid) * np.sqrt(n))) * 1.5
    return model


def identify(docs: DataFrame, sample: int = 400) -> DataFrame:
    """``docs`` with ``lang_id``, ``cross_entropy`` (nats a symbol), ``margin`` to the second language and ``lang_accepted``."""
    docs = docs.drop("lang_id", "cross_entropy", "margin", "lang_accepted")
    model = train(docs.select("doc_id", "lang", "text"), sample)
    extra = [T.StructField("lang_id", T.StringType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("lang_accepted", T.BooleanType())]
    if model is None:
        return docs.select("*", *[F.lit("und" if f.name == "lang_id" else False if f.name == "lang_accepted" else None).cast(f.dataType).alias(f.name) for f in extra])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample and 2^24 grams a language
    names = [*docs.columns, *(f.name for f in extra)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        langs = np.array([*m["langs"], "und"], object)
        limit, spread = np.array(m["limit"]), np.array(m["spread"])
        for batch in batches:
            for a, b in W.slices(W.buffers(batch["text"])[1], CHARS):
                part = batch.slice(a, b - a)
                sums, n = scorer(part["text"])
                best = sums.argmax(1)
                rows = np.arange(len(best))
                e = -sums[rows, best] / np.maximum(n, 1)
                rest = sums.copy()
                rest[rows, best] = -np.inf
                margin = (sums[rows, best] - rest.max(1)) / np.maximum(n, 1)
                ok = (n >= MIN_GRAMS) & (e <= np.maximum(limit[best], limit[best] + spread[best] / np.sqrt(np.maximum(n, 1))))
                none = n < MIN_GRAMS
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array(langs[np.where(ok, best, len(langs) - 1)], pa.string()), pa.array(e, mask=none), pa.array(margin, mask=none | ~np.isfinite(margin)), pa.array(ok),
                ], names)

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *extra]))
