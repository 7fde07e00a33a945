"""Approximate nearest neighbours: forests of random-projection trees, one priority queue over all trees, exact reranking.

A routing tree, its medians taken from a bounded sample, splits the vectors into
cells of about ``CELL``; each cell is one task and holds a forest over all its
vectors.  A query visits the cells nearest to it.  In a cell one queue, ordered
by the squared distance to the region of a branch, runs over the branches of all
trees; ``probes`` leaves are opened and their members compared exactly.  Queries
are taken in blocks: a frontier of the ``probes`` best branches, kept level by
level, is the queue's result, as a branch costs no less than the one above it.
How many cells and leaves to open is not guessed: it is what the true neighbours
of some rows, found by scanning all vectors, take for the share ``recall``.

Equal vectors are one entry of the index and one query, however many rows have
them; rows are put back at the end.  Cells that are still too large are split
into blocks, each of which its queries visit.

Cases: null ids, null or empty vectors, nulls or NaN in them, zero vectors and vectors
whose length is not the commonest one are left out; of rows with the same id the least vector counts;
equal similarities go by id; with one vector or none there are no neighbours; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

TREES = 8
LEAF = 64
#: Vectors of a cell, which is one task (16 MB at 64 dimensions).
CELL = 1 << 16
#: Rows whose projections fit the routing tree, at most; it has 2^MAX_DEPTH cells at most.
SAMPLE = 1 << 18
MAX_DEPTH = 14
#: Rows whose true neighbours tell how much to open.
CALIBRATE = 192
BLOCK = 512


def unit(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v, x, y): one unit vector of the common length per id with two hashes of it, and that length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.where(F.size("v") == dim).withColumn("n", norm)
    rows = rows.select("id", F.transform("v", lambda x: (x / F.col("n"))).cast("array<float>").alias("v"))
    return rows.select("id", "v", F.xxhash64("v").alias("x"), F.xxhash64("v", F.lit(1)).alias("y")), dim


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def directions(dim: int, trees: int, depth: int, seed: int) -> np.ndarray:
    """Unit directions by tree and level."""
    d = np.random.default_rng(seed).normal(size=(dim, trees * max(depth, 1))).astype(np.float32)
    return d / np.linalg.norm(d, axis=0)


class Forest:
    """Thresholds by tree and node (breadth first); members by tree and leaf, as many in each."""

    def __init__(self, dim: int, trees: int, depth: int, seed: int = 7):
        self.trees, self.depth = trees, depth
        self.directions = directions(dim, trees, depth, seed)
        self.cut = np.zeros((trees, max(1, (1 << depth) - 1)), np.float32)
        self.members = np.zeros((trees, 1 << depth, 0), np.int32)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions).reshape(len(x), self.trees, -1)

    def fit(self, p: np.ndarray) -> Forest:
        """Split at medians; places are filled up with repeats so that all leaves are of one size."""
        n = len(p)
        pad = -n % (1 << self.depth)
        every = np.concatenate([np.arange(n), np.random.default_rng(n).choice(n, pad, replace=False)]).astype(np.int32)
        leaves = []
        for t in range(self.trees):
            cur = every[None, :]
            for d in range(self.depth):
                half = cur.shape[1] // 2
                value = p[cur, t, d]
                order = np.argpartition(value, half, axis=1)
                low = np.take_along_axis(value, order[:, :half], 1).max(1)
                high = np.take_along_axis(value, order[:, half : half + 1], 1)[:, 0]
                self.cut[t, (1 << d) - 1 : (2 << d) - 1] = (low + high) / 2
                cur = np.take_along_axis(cur, order, 1).reshape(2 << d, half)
            leaves.append(cur)
        self.members = np.stack(leaves)
        return self

    def node(self, p: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row."""
        k = np.zeros(p.shape[:2], np.int64)
        t = np.arange(self.trees)[None, :]
        for d in range(self.depth):
            k = 2 * k + (p[:, :, d] > self.cut[t, (1 << d) - 1 + k])
        return k

    def queue(self, p: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, their costs) that a priority queue over all trees opens first, by query, in order of cost."""
        b, rows = len(p), np.arange(len(p))[:, None]
        cost = np.zeros((b, self.trees), np.float32)
        tree = np.broadcast_to(np.arange(self.trees), cost.shape)
        node = np.zeros(cost.shape, np.int64)

        def best(width: int) -> None:
            nonlocal cost, tree, node
            if cost.shape[1] > width:
                keep = np.argpartition(cost, width - 1, axis=1)[:, :width]
                cost, tree, node = (np.take_along_axis(x, keep, 1) for x in (cost, tree, node))

        for d in range(self.depth):
            best(probes)
            m = p[rows, tree, d] - self.cut[tree, (1 << d) - 1 + node]
            cost = np.concatenate([cost + np.maximum(m, 0) ** 2, cost + np.minimum(m, 0) ** 2], 1)
            tree, node = np.concatenate([tree, tree], 1), np.concatenate([2 * node, 2 * node + 1], 1)
        best(probes)
        order = np.argsort(cost, axis=1, kind="stable")
        cost, tree, node = (np.take_along_axis(x, order, 1) for x in (cost, tree, node))
        return (tree << self.depth) + node, cost

    def search(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) of the k most similar rows in the opened leaves; ties by id."""
        out = []
        size = self.members.shape[2]
        flat = self.members.reshape(-1, size)
        for a in range(0, len(q), BLOCK):
            part = q[a : a + BLOCK]
            leaf, _ = self.queue(self.project(part), probes)
            width = leaf.shape[1]
            order = np.argsort(leaf.ravel(), kind="stable")
            opened, first = np.unique(leaf.ravel()[order], return_index=True)
            sims = np.empty((leaf.size, size), np.float32)
            for f, u, v in zip(opened.tolist(), first.tolist(), [*first[1:].tolist(), leaf.size]):
                pairs = order[u:v]
                sims[pairs] = part[pairs // width] @ x[flat[f]].T
            sims = sims.reshape(len(part), -1)
            # a row stands in a leaf of each tree at most twice, so so many places hold k different rows
            most = min(sims.shape[1], 2 * k * self.trees)
            low = np.partition(sims, sims.shape[1] - most, axis=1)[:, sims.shape[1] - most]
            i, j = np.nonzero(sims >= low[:, None])
            row = flat[leaf[i, j // size], j % size]
            new = np.unique(i * len(x) + row, return_index=True)[1]
            i, row = i[new], row[new]
            s = (part[i] * x[row]).sum(1)
            order = np.lexsort((ids[row], -s, i))
            i, row, s = i[order], row[order], s[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            out.append((a + i[keep], row[keep], s[keep]))
        return tuple(np.concatenate(c) for c in zip(*out))


def grow(x: np.ndarray, trees: int, leaf: int) -> Forest:
    """A forest over all rows of ``x``."""
    f = Forest(x.shape[1], trees, max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf)))))
    return f.fit(f.project(x))


def sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` rows, the same at every run."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("x", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * (most / n)))


def nearest_by_scan(rows: DataFrame, q: np.ndarray, qid: np.ndarray, k: int, dim: int) -> pa.Table:
    """(q, v) of the k true neighbours of each query; each task keeps its k best."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
        for b in batches:
            ids, x = np.concatenate([ids, b["id"].to_numpy()]), np.concatenate([x, _matrix(b["v"], dim)])
            if not len(ids):
                continue
            sims = np.where(ids[None, :] == qid[:, None], -9, q @ x.T)
            keep = np.unique(np.argpartition(-sims, min(k, len(ids) - 1), axis=1)[:, :k]) if len(ids) > k else np.arange(len(ids))
            ids, x = ids[keep], x[keep]
        if len(ids):
            sims = np.where(ids[None, :] == qid[:, None], -9, q @ x.T)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(q)), top.shape[1])
            s = sims[i, top.ravel()]
            ok = s > -9
            at = top.ravel()[ok]
            yield pa.RecordBatch.from_arrays([pa.array(i[ok].astype(np.int32)), pa.array(ids[at]), pa.array(s[ok]), pa.array(list(x[at]), pa.list_(pa.float32()))], ["q", "id", "s", "v"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    found = rows.select("id", "v").mapInArrow(scan, "q int, id long, s float, v array<float>")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "v").toArrow()


def calibrate(rows: DataFrame, n: int, router: Forest, k: int, dim: int, trees: int, leaf: int, recall: float) -> tuple[int, int]:
    """(cells to visit, leaves to open in each): both find the square root of ``recall`` of the true neighbours of CALIBRATE rows.

    Leaves are tried in a cell of sampled vectors and those neighbours.
    """
    share = recall**0.5
    asked = sampled(rows, n, CALIBRATE).toArrow()
    q, qid = _matrix(asked["v"], dim), asked["id"].to_numpy()
    true = nearest_by_scan(rows, q, qid, k, dim)
    if not true.num_rows:
        return 1, 1
    of, near = true["q"].to_numpy(), _matrix(true["v"], dim)

    def needed(rank: np.ndarray) -> int:
        return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(share * len(rank))) - 1)]) + 1

    cells = 1
    if router.depth:
        opened, _ = router.queue(router.project(q), 1 << router.depth)
        cells = needed((opened[of] == router.node(router.project(near))).argmax(1))
    some = _matrix(sampled(rows, n, CELL).select("v").toArrow()["v"], dim)
    x = np.concatenate([near, some])[: max(len(some), len(near))]
    forest = grow(x, trees, leaf)
    opened, _ = forest.queue(forest.project(q), trees << forest.depth)
    place = np.empty_like(opened)
    np.put_along_axis(place, opened, np.broadcast_to(np.arange(opened.shape[1]), opened.shape), 1)
    # the leaves that hold the neighbour, tree by tree; places by rows of x
    where = np.empty((trees, len(x)), np.int64)
    t = np.repeat(np.arange(trees), forest.members[0].size)
    where[t, forest.members.ravel()] = np.tile(np.repeat(np.arange(1 << forest.depth), forest.members.shape[2]), trees) + (t << forest.depth)
    rank = np.stack([place[of, where[k, : len(near)]] for k in range(trees)]).min(0)
    return cells, needed(rank)


def search(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", asked: Column | None = None, trees: int = TREES, leaf: int = LEAF, recall: float = 0.95, cell: int = CELL) -> DataFrame:
    """(id, neighbour, rank, cosine): the k nearest others by cosine of every vector whose ``id`` is ``asked`` (all by default)."""
    spark = vectors.sparkSession
    rows, dim = unit(vectors, id_col, vec_col)
    rows = store.cut(rows.withColumn("asked", F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))))
    schema = "id long, neighbour long, cosine float"
    # equal vectors are one entry, named by their smallest id
    entries = store.cut(rows.groupBy("x", "y").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.bool_or("asked").alias("asked"), F.count("*").alias("copies")))
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, rank int, cosine double")
    router = Forest(dim, 1, min(MAX_DEPTH, max(0, int(np.ceil(np.log2(n / cell))))), 11)
    if router.depth:
        p = sampled(entries, n, SAMPLE).select("v").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(list(router.project(_matrix(b["v"], dim))[:, 0]))], ["p"]) for b in it if b.num_rows), "p array<float>")
        router.fit(_matrix(p.toArrow()["p"], router.depth)[:, None, :])
        router.members = router.members[:, :, :0]
    visits, probes = calibrate(entries, n, router, k, dim, trees, leaf, recall)
    model = spark.sparkContext.broadcast(router)  # 2^MAX_DEPTH thresholds at most

    def placed(it: Iterator[pa.RecordBatch], ask: bool) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                p = model.value.project(_matrix(b["v"], dim))
                to = model.value.queue(p, visits)[0] if ask else model.value.node(p)
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(list(to), pa.list_(pa.int64()))], ["id", "v", "cells"])

    shape = "id long, v array<float>, cells array<long>"
    base = store.cut(entries.select("id", "v").mapInArrow(lambda it: placed(it, False), shape).select("id", "v", F.col("cells")[0].alias("cell")))
    counts = {r["cell"]: r["count"] for r in base.groupBy("cell").count().where(F.col("count") > 2 * cell).collect()}  # 2^MAX_DEPTH rows at most
    blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, -(-m // cell))]), F.col("cell")), F.lit(1)) if counts else F.lit(1)
    base = base.withColumn("block", F.pmod(F.xxhash64("id"), blocks.cast("long")))
    ask = entries.where("asked").select("id", "v").mapInArrow(lambda it: placed(it, True), shape)
    ask = ask.select("id", "v", F.explode("cells").alias("cell")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))

    def open_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "neighbour", "cosine"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names)
        x, ids = _matrix(left["v"], dim), left["id"].to_numpy()
        q, qid = _matrix(right["v"], dim), right["id"].to_numpy()
        i, row, s = grow(x, trees, leaf).search(x, ids, q, k + 1, probes)
        return pa.table([pa.array(qid[i]), pa.array(ids[row]), pa.array(s)], names)

    keys = ["cell", "block"]
    found = ask.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(lambda r, l: open_cell(l, r), schema)
    by = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    found = store.cut(found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).drop("r"))
    # rows with equal vectors: the smallest k + 1 ids of each entry are all that can be listed
    twins = rows.join(entries.where("copies > 1").select("x", "y", F.col("id").alias("entry")), ["x", "y"]).select("entry", "id", "asked")
    first = twins.withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).where(F.col("r") <= k + 1)
    others = first.where("id <> entry").select(F.col("entry").alias("neighbour"), F.col("id").alias("other"))
    found = found.union(found.join(others, "neighbour").select("id", F.col("other").alias("neighbour"), "cosine"))
    found = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).drop("r")
    single = entries.where("asked and copies = 1").select(F.col("id").alias("entry"), "id")
    queries = single.union(twins.where("asked").select("entry", "id"))
    listed = queries.join(found.withColumnRenamed("id", "entry"), "entry").where("id <> neighbour")
    return listed.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("id", "neighbour", "rank", F.col("cosine").cast("double").alias("cosine"))
