"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Cases: a null text counts as empty; a null language or source is a value of its
own; repeated rows are scored alike; with no labelled document of both kinds
every document is kept with score 1.  Other columns pass through; those called
like a column of the result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from . import words as W

WORD_BITS = 18
STATS = 8
LEVELS = 12
META = 1 << 10
WIDTH = (1 << WORD_BITS) + STATS * LEVELS + META
RANK = 8
WORD_VALUE = 0.3

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "digit", "mark", "symbol", "line", "blank")}
_CLASS["upper"][65:91] = True
_CLASS["digit"][48:58] = True
_CLASS["mark"][[33, 44, 46, 58, 59, 63]] = True
_CLASS["symbol"][[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 124, 126]] = True
_CLASS["line"][10] = True
_CLASS["blank"][[9, 13, 32]] = True


def _tag(values: list, salt: int) -> np.ndarray:
    """Bucket of a metadata value; null has a bucket too."""
    seen: dict = {}
    for v in values:
        if v not in seen:
            b = np.frombuffer(("\0null" if v is None else str(v)).encode(), np.uint8)
            h = W.hashes(b, np.zeros(1, np.int64), np.array([len(b)]))[0] if len(b) else W.U64(7)
            seen[v] = int(W.mix64(np.array([h ^ W.U64(salt)]))[0] % W.U64(META))
    return np.array([seen[v] for v in values], np.int64)


def features(texts: pa.Array, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) triples in document order: each distinct word once, each statistic and tag once."""
    data, off = W.buffers(texts)
    n = len(off) - 1
    starts, ends, wo = W.spans(data, off, W.NON_WORD)
    h = W.hashes(data, starts, ends, W.LOWER)
    doc = W.each(wo)
    key = np.unique(doc.astype(np.int64) << WORD_BITS | (h >> W.U64(64 - WORD_BITS)).astype(np.int64))
    wdoc, wfeat = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(wdoc, minlength=n)
    size, count = np.maximum(np.diff(off), 1), np.maximum(np.diff(wo), 1)

    def share(table: np.ndarray) -> np.ndarray:
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=run[1:])
        return (run[off[1:]] - run[off[:-1]]) / size

    letters = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=letters[1:])
    stats = [share(t) for t in _CLASS.values()] + [distinct / count, (letters[wo[1:]] - letters[wo[:-1]]) / count / 20]
    rows = np.arange(n)
    sdoc, sfeat = [], []
    for k, x in enumerate(stats):
        level = np.minimum((np.sqrt(np.clip(x, 0, 1)) * LEVELS).astype(np.int64), LEVELS - 1)
        sdoc.append(rows)
        sfeat.append((1 << WORD_BITS) + k * LEVELS + level)
    for k, v in enumerate((langs, sources)):
        sdoc.append(rows)
        sfeat.append((1 << WORD_BITS) + STATS * LEVELS + _tag(v, k + 1))
    d = np.concatenate([wdoc, *sdoc])
    f = np.concatenate([wfeat, *sfeat])
    x = np.concatenate([np.full(len(wdoc), WORD_VALUE), np.full(n * len(sdoc), 1.0)])
    order = np.argsort(d, kind="stable")
    return d[order], f[order], x[order]


def score(model: dict, d: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """w0 + sum w x + 1/2 sum_k [(sum v x)^2 - sum v^2 x^2], linear in the number of features."""
    vx = model["v"][f] * x[:, None]
    first = np.searchsorted(d, np.arange(n))
    s, q = np.add.reduceat(vx, first), np.add.reduceat(vx * vx, first)
    return model["w0"] + np.bincount(d, model["w"][f] * x, n) + 0.5 * (s * s - q).sum(1)


def fit(d: np.ndarray, f: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 20, rate: float = 0.2, decay: float = 5e-4, least: int = 4, seed: int = 1) -> dict:
    """Adaptive-gradient logistic training; classes weigh alike; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    known = np.bincount(f, minlength=WIDTH) >= least  # a rarer feature would only be learnt by heart
    part = known[f]
    d, f, x = d[part], f[part], x[part]
    model = {"w0": 0.0, "w": np.zeros(WIDTH), "v": rng.normal(0, 0.02, (WIDTH, RANK)) * known[:, None]}
    gw, gv, g0 = np.full(WIDTH, 1e-3), np.full((WIDTH, RANK), 1e-3), 1e-3
    n = len(y)
    weight = np.where(y, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    first = np.searchsorted(d, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 128):
            rows = order[a : a + 128]
            take = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            ff, xx = f[take], x[take]
            vx = model["v"][ff] * xx[:, None]
            s = np.zeros((len(rows), RANK))
            np.add.at(s, local, vx)
            z = model["w0"] + np.bincount(local, model["w"][ff] * xx, len(rows)) + 0.5 * (s * s).sum(1) - 0.5 * np.bincount(local, (vx * vx).sum(1), len(rows))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            used, at = np.unique(ff, return_inverse=True)
            dw = np.bincount(at, err[local] * xx, len(used)) + decay * model["w"][used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, at, (err[local] * xx)[:, None] * (s[local] - vx))
            dv += decay * model["v"][used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += err.sum() ** 2
            model["w"][used] -= rate * dw / np.sqrt(gw[used])
            model["v"][used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            model["w0"] -= rate * err.sum() / np.sqrt(g0)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, clean_loss: float = 0.005) -> dict | None:
    """Fit on at most ``sample`` labelled documents (those of the lowest hashed ids) and calibrate the cut.

    Good means quality 1 and not toxic.  The cut is chosen on the fifth of the
    sample that was held out: the one that errs least, but no higher than where
    it would lose a share ``clean_loss`` of the good documents.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(ids), "doc_id")  # at most ``sample`` rows

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            d, f, x = features(b["text"], b["lang"].to_pylist(), b["source"].to_pylist())
            first = np.searchsorted(d, np.arange(len(t) + 1))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["good"], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(f.astype(np.int32)))], ["doc_id", "good", "f"])

    got = rows.mapInArrow(collect, "doc_id long, good boolean, f array<int>").toArrow().sort_by("doc_id")
    good = np.array(got["good"].to_pylist(), bool)
    if not good.any() or good.all():
        return None
    lists = got["f"].combine_chunks()
    first, f = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)
    f = f[first[0] :]
    first = first - first[0]
    d, x = W.each(first), np.where(f < 1 << WORD_BITS, WORD_VALUE, 1.0)
    held = np.arange(len(good)) % 5 == 4
    part = ~held[d]
    renum = np.cumsum(~held) - 1
    model = fit(renum[d[part]], f[part], x[part], good[~held])
    z = score(model, d, f, x, len(good))[held]
    h = good[held]
    if h.any() and not h.all():
        cuts = np.unique(np.concatenate([z, [0.0]]))
        miss = np.array([(z[h] < c).mean() + (z[~h] >= c).mean() for c in cuts])
        best = cuts[miss == miss.min()]
        low = z[~h & (z < best[0])].max(initial=best[0] - 1)
        cut = min((best[0] + low) / 2, float(np.quantile(z[h], clean_loss)))
    else:
        cut = 0.0
    return {"w0": model["w0"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32), "cut": float(cut), "held": (z, h)}


def classify(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """``docs`` with ``quality_score`` (a probability) and ``quality_keep``; no shuffle, one pass over the texts."""
    docs = docs.drop("quality_score", "quality_keep")
    model = train(docs, labels, sample)
    if model is None:
        return docs.withColumns({"quality_score": F.lit(1.0), "quality_keep": F.lit(True)})
    model.pop("held")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x (RANK + 1) floats, whatever the input
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_keep", T.BooleanType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            off = W.buffers(batch["text"])[1]
            for a, b in W.slices(off):
                part = batch.slice(a, b - a)
                d, f, x = features(part["text"], part["lang"].to_pylist(), part["source"].to_pylist())
                z = score(m, d, f, x, len(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), pa.array(z >= m["cut"])], [*names, "quality_score", "quality_keep"])

    return docs.mapInArrow(apply, schema)


def kept(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """The documents that the classifier keeps, all columns unchanged."""
    renamed = {c: n for c, n in zip(("quality_score", "quality_keep"), store.fresh(docs, "quality_score", "quality_keep")) if c != n}
    rows = classify(docs.withColumnsRenamed(renamed), labels, sample).where("quality_keep").drop("quality_score", "quality_keep")
    return rows.withColumnsRenamed({n: c for c, n in renamed.items()})
