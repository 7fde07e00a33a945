"""Vectors as arrays: normalisation, similarity, deterministic embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scale = lambda x: let(norm(x), lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda y: y / n)))
    return let(v.cast("array<double>"), scale)


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded as DuckDB rounds doubles: scaled first, half away from zero, and the sign stays on a zero (Spark's round drops it)."""
    unit = float(10**digits)
    return F.round(F.abs(x) * unit) / unit * F.signum(x)


def similarity(a: Column, b: Column) -> Column:
    """The cosine of unit vectors, not below 0."""
    return F.greatest(F.lit(0.0), dot(a, b))


def from_distance(d: Column, missing: float = 0.5) -> Column:
    """V04 by Euclidean distance of unit vectors."""
    return F.when(d.isNull(), F.lit(missing)).otherwise(F.greatest(F.lit(0.0), 1 - d * d / 2))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def literal(values: list[float]) -> Column:
    """A query vector as a literal, so that search is a projection and no join."""
    return F.array(*[F.lit(float(x)) for x in values])


class Provider(Protocol):
    """What embeds texts: a Column expression for documents and one for queries."""

    def documents(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class Md5Embedding:
    """The 16 bytes of the md5 as shares of 255, tiled; no Python is involved."""

    def __init__(self, tiles: int = 8):
        self.tiles = tiles

    def documents(self, text: Column) -> Column:
        one = let(F.md5(text), lambda h: F.array(*[F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("double") / 255.0 for k in range(16)]))
        return F.flatten(F.array_repeat(one, self.tiles)) if self.tiles > 1 else one

    queries = documents


class BigramEmbedding:
    """Counts of character pairs by the low seven bits of their md5."""

    def documents(self, text: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2))
        slots = F.transform(pairs, lambda p: F.conv(F.substring(F.md5(p), 31, 2), 16, 10).cast("int") % 128)
        counts = let(slots, lambda v: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.size(F.filter(v, lambda s: s == k)).cast("double")))
        return F.when(F.length(text) > 1, counts).otherwise(F.array_repeat(F.lit(0.0), 128))

    queries = documents


class ModelEmbedding:
    """A loaded model behind an Arrow UDF; ``load`` runs once per Python worker.

    ``load()`` returns a function from a list of texts to a list of vectors.
    """

    _models: dict = {}

    def __init__(self, load, name: str, batch: int = 20):
        self.load, self.name, self.batch = load, name, batch

    def _udf(self, prefix: str):
        load, name, batch, models = self.load, self.name, self.batch, ModelEmbedding._models

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if name not in models:
                models[name] = load()
            for texts in it:
                ready = [t if t.startswith(prefix) else prefix + t for t in texts.fillna("")]
                out: list = []
                for a in range(0, len(ready), batch):
                    out += list(models[name](ready[a : a + batch]))
                yield pd.Series(out)

        return embed

    def documents(self, text: Column) -> Column:
        return self._udf("search_document: ")(text)

    def queries(self, text: Column) -> Column:
        return self._udf("search_query: ")(text)


class ModelScorer:
    """A cross-encoder behind an Arrow UDF; its scores go through a sigmoid.

    ``load()`` returns a function from (query, texts) to raw scores.  It runs
    once per Python worker, for ``wait`` seconds at most; a load that failed or
    took longer is not tried again there, and its scores are null.
    """

    #: name -> (state, model); a name that isn't here is idle.
    _models: dict = {}

    def __init__(self, load, name: str, batch: int = 20, wait: float = 120.0):
        self.load, self.name, self.batch, self.wait = load, name, batch, wait

    def model(self):
        """The loaded model or None; a Python worker runs one task at a time, so it is loaded once."""
        if self.name not in ModelScorer._models:
            pool = ThreadPoolExecutor(1)
            try:
                ModelScorer._models[self.name] = ("done", pool.submit(self.load).result(self.wait))
            except Exception:  # whatever a library raises, its scores are missing
                ModelScorer._models[self.name] = ("failed", None)
            finally:
                pool.shutdown(wait=False)
        return ModelScorer._models[self.name][1]

    def state(self) -> str:
        return ModelScorer._models.get(self.name, ("idle", None))[0]

    def scores(self, query: str, text: Column) -> Column:
        scorer = self

        @F.pandas_udf(T.DoubleType())
        def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = scorer.model()
            for texts in it:
                ready, out = list(texts.fillna("")), []
                for a in range(0, len(ready), scorer.batch):
                    part = ready[a : a + scorer.batch]
                    out += [None] * len(part) if model is None else [float(x) for x in model(query, part)]
                yield pd.Series(out, dtype="float64")

        return 1 / (1 + F.exp(-score(text)))
