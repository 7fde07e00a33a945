"""N-gram Jaccard join through a token-group matrix.

Each document is the set of its distinct word ``N``-grams (a document of fewer
words is one gram).  Every gram of every set is counted over the corpus; a set
of which too few grams stand in any other document has no partner.  The rest is
put in order of frequency, rarest first, and two similar sets have a gram in
common among all but the last of them, those that a pair may lack and still
reach the threshold (prefix filter, exact).  Each of these grams leads to the
group of the first set that has it; the matrix holds the groups of each set.
A query's overlap with a group's union bounds its similarity to every member,
so only sets within the bound are opened and compared.

* Nothing is sampled: every pair that reaches the threshold is found.
* Identical sets are one member; its documents are linked to the smallest id.
* Links are counted by blocks of members; blocks that reach the threshold for sure are not compared.
* Grams travel in blocks, one for each slice of documents and part of the hashes;
  those of one document alone go no further.  ``PART`` bounds a task's share.
* A group too large for one task is cut into blocks, and each pair of blocks is a task.
* Every join has one plan at every size; nothing that grows with the input is broadcast.

Cases: null and empty texts (no words) and null ids join nothing; of rows with the same id the
smallest text counts; ties go to the smaller id; texts are read whole, however long; extra columns are
not read; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import words as W

N = 3
THRESHOLD = 0.5
#: Bytes of text whose grams one task counts, and those of a slice of documents.
PART = 1 << 24
SLICE = 1 << 22
#: Grams of a group's members that one task holds.
TASK = 1 << 23


def gram_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram), distinct and in order of document."""
    s, e, wo = W.spans(data, off)
    h = W.hashes(data, s, e)
    g, go = W.ngrams(h, wo, n)
    count = np.diff(wo)
    doc = W.each(go)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([W.mix64(np.array([int(np.bitwise_xor.reduce(h[wo[d] : wo[d + 1]] * W._STEP[: count[d]]))], W.U64))[0] for d in short], W.U64)
        doc = np.concatenate([doc, short])
        g = np.concatenate([g, whole])
    # one key a gram: document, hash; repeats of a gram are neighbours
    bits = W.U64(int(len(off)).bit_length())
    key = doc.astype(np.uint64) << W.U64(64) - bits | g >> bits
    order = np.argsort(key)
    key, doc, g = key[order], doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = key[1:] != key[:-1]
    if (g[1:] != g[:-1])[~new[1:]].any():  # the key has lost bits that tell grams apart
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """Grams that a set of this size has in common with a similar one, at least."""
    return np.maximum(1, np.ceil(size * threshold - 1e-9)).astype(np.int64)


def binary(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The rows between neighbouring cuts as one binary value each."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * rows.itemsize).astype(np.int64)), pa.py_buffer(rows)]).cast(pa.binary())


def unpack(values: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, row of each) of a column of :func:`binary`."""
    data, off = W.buffers(values)
    return data.view(kind), np.repeat(np.arange(len(off) - 1), np.diff(off) // np.dtype(kind).itemsize)


def numbers(ids: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the narrowest type that holds them all."""
    return ids.astype(np.min_scalar_type(int(ids.max())))


def count_shared(docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """(doc_id, set_id, size, grams): fingerprint and size of the set and those of its grams that other documents have, rarest first.

    ``grams`` is empty where they are too few for any similar set.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(int(size // PART) + 1, 1 << 15)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a slice is named by its smallest id; part ``parts`` has the sizes and fingerprints of its sets
        for batch in batches:
            data, off = W.buffers(batch["text"])
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for a, b in W.slices(off, SLICE):
                d, g = gram_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                if not len(d):
                    continue
                have, first, size = np.unique(d, return_index=True, return_counts=True)
                mark = W.mix64(np.add.reduceat(W.mix64(g + W.U64(1)), first) + size.astype(W.U64))
                base = int(ids[a:b][have].min())
                local = numbers((ids[a:b].view(np.uint64) - W.U64(base & (1 << 64) - 1))[have])
                part = (g >> W.U64(32)) % W.U64(parts)
                order = np.argsort(part.astype(np.uint16), kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))])
                at = np.repeat(local, size)[order]
                full = np.flatnonzero(np.diff(cuts))
                cuts = np.append(cuts[full], cuts[-1])
                key = pa.array([*full.tolist(), parts], pa.int32())
                ends = np.array([0, len(have)])
                yield pa.RecordBatch.from_arrays(
                    [
                        key, pa.array(np.full(len(key), base, np.int64)), pa.array(np.full(len(key), local.itemsize, np.int32)),
                        pa.concat_arrays([binary(at, cuts), binary(local, ends)]),
                        pa.concat_arrays([binary(g[order], cuts), binary(mark, ends)]),
                        pa.concat_arrays([pa.nulls(len(full), pa.binary()), binary(size.astype(np.int64), ends)]),
                    ],
                    ["part", "base", "width", "ids", "grams", "counts"],
                )

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() == parts:
            return rows
        g, row = unpack(rows["grams"], np.uint64)
        order = np.argsort(g)
        sorted_ = g[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        often = np.diff(np.append(first, len(g)))
        count = np.empty(len(g), np.int64)
        count[order] = np.repeat(often, often)
        keep = np.flatnonzero(count > 1)
        cuts = np.searchsorted(row[keep], np.arange(len(rows) + 1))
        widths = rows["width"].to_numpy()
        text, off = W.buffers(rows["ids"])
        left = np.searchsorted(row, np.arange(len(rows)))
        ids = [text[off[r] : off[r + 1]].reshape(-1, widths[r])[keep[cuts[r] : cuts[r + 1]] - left[r]].tobytes() for r in range(len(rows))]
        out = [rows["part"], rows["base"], rows["width"], pa.array(ids, pa.binary()), binary(g[keep], cuts), binary(count[keep], cuts)]
        return pa.Table.from_arrays(out, rows.column_names).filter(pa.array(np.diff(cuts) > 0))

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        widths = rows["width"].to_numpy()
        text, off = W.buffers(rows["ids"])
        local = np.concatenate([text[off[r] : off[r + 1]].view(f"u{widths[r]}").astype(np.uint64) for r in range(len(rows))])
        g, row = unpack(rows["grams"], np.uint64)
        df, _ = unpack(rows["counts"], np.int64)
        whole = (rows["part"].to_numpy() == parts)[row]
        ids, mark, size = local[whole], g[whole], df[whole]
        order = np.argsort(ids)
        ids, mark, size = ids[order], mark[order], size[order]
        local, g, df = local[~whole], g[~whole], df[~whole]
        doc = np.searchsorted(ids, local)
        enough = np.bincount(doc, minlength=len(ids)) >= needed(size, threshold)
        on = enough[doc]
        doc, g, df = doc[on], g[on], df[on]
        order = np.lexsort((g, df, doc))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(len(ids) + 1)).astype(np.int32)), W.to_long(g[order]))
        names = (ids + W.U64(key[0].as_py() & (1 << 64) - 1)).view(np.int64)
        return pa.Table.from_arrays([pa.array(names), W.to_long(mark), pa.array(size.astype(np.int32)), lists], ["doc_id", "set_id", "size", "grams"])

    block = "part int, base long, width int, ids binary, grams binary, counts binary"
    # sizes and fingerprints pass the counting task, slice by slice
    sent = docs.select("doc_id", "text").mapInArrow(send, block)
    spread = F.when(F.col("part") == parts, F.col("base")).otherwise(F.lit(0))
    back = sent.groupBy("part", spread.alias("spread")).applyInArrow(count, block)
    return back.groupBy("base").applyInArrow(gather, "doc_id long, set_id long, size int, grams array<long>")


def one_each(docs: DataFrame) -> DataFrame:
    """Rows of the same id only matter where they are; the check is one aggregate of ids and never moves texts."""
    ids = docs.where("doc_id is not null").select("doc_id", "text")
    repeated = ids.groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return ids
    return store.cut(ids.groupBy("doc_id").agg(F.min("text").alias("text")))


def _found(docs: DataFrame, threshold: float, n: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, rep, copies) of every document with words, what :func:`verify` finds between the smallest ids)."""
    docs = one_each(docs)
    sets = store.cut(count_shared(docs, threshold, n))
    members = sets.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("grams").alias("grams"))
    members = store.cut(members)
    own = sets.select("set_id", "doc_id").join(members.select("set_id", "rep", "copies").hint("merge"), "set_id").select("doc_id", "rep", "copies")
    members = members.where(F.size("grams") > 0)
    return store.cut(own), store.cut(verify(members, store.cut(matrix(members, threshold)), threshold, kind))


def pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b, one pair for each two different sets, between their smallest ids, and one from each document to the smallest id of its own set."""
    own, near = _found(docs, threshold, n, "pairs")
    same = own.where("doc_id > rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return same.union(near.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, class_id, same_as, links) of every document that has a similar one.

    ``links`` counts the documents that reach the threshold with it, copies and
    all; ``same_as`` is the smallest id with the same set, ``class_id`` the
    smallest id that similarities lead to.
    """
    own, near = _found(docs, threshold, n, "links")
    links = near.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    edges = near.where("links is null").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
    top = components(edges).withColumnsRenamed({"doc_id": "rep", "first": "class_id"})
    out = own.join(links.hint("merge"), "rep", "left").where("copies > 1 or more is not null").join(top.hint("merge"), "rep", "left")
    return out.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("same_as"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"))


def matrix(members: DataFrame, threshold: float) -> DataFrame:
    """(id, grps): the groups of each set that may have a similar one; a group is named by its first member.

    Grams of one document alone come first in the order of frequency and lead
    nowhere; of the others the last ones, which a pair may lack and still reach
    the threshold, are left out.  Each gram left leads to the first set that has
    it, so two sets with that gram meet there.
    """
    need = F.greatest(F.lit(1), F.ceil(F.col("size") * threshold - 1e-9)).cast("int")
    rows = members.select("rep", F.explode(F.slice("grams", F.lit(1), F.size("grams") - need + 1)).alias("gram"))
    by = Window.partitionBy("gram")
    cells = rows.select("rep", F.min("rep").over(by).alias("grp"), F.max("rep").over(by).alias("last")).where("grp < last")
    return cells.groupBy(F.col("rep").alias("id")).agg(F.array_sort(F.collect_set("grp")).alias("grps"))


class Lists:
    """Lists of hashes by row, counted against each other in blocks of dense products."""

    def __init__(self, rows: list[np.ndarray]):
        size = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), size)
        self.first = np.concatenate([[0], np.cumsum(size)])

    def keep(self, flag: np.ndarray) -> None:
        n = len(self.first) - 1
        self.flat, self.row = self.flat[flag], self.row[flag]
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    def dense(self, a: int, b: int, cols: np.ndarray) -> np.ndarray:
        part = slice(self.first[a], self.first[b])
        at = np.searchsorted(cols, self.flat[part])
        ok = (at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == self.flat[part])
        m = np.zeros((b - a, len(cols)), np.float32)
        m[self.row[part][ok] - a, at[ok]] = 1
        return m

    def common(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """How much the rows a..b have in common with the rows c..d."""
        out = np.zeros((b - a, d - c), np.float32)
        cols = np.intersect1d(self.flat[self.first[a] : self.first[b]], self.flat[self.first[c] : self.first[d]])
        for x in range(0, len(cols), 8192):
            part = cols[x : x + 8192]
            out += self.dense(a, b, part) @ self.dense(c, d, part).T
        return out


def similar(sets: list[np.ndarray], size: np.ndarray, groups: list[np.ndarray], side: np.ndarray | None, threshold: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place, similarity) of the pairs of a group that reach the threshold and have no earlier group in common.

    ``sets`` have the grams that other documents have, ``size`` counts them all.
    The union that bounds a member holds the grams which another member has too;
    one that has too few of them can't reach the threshold with any and is never
    opened.  Where ``side`` is given, pairs are of different sides.
    """
    grams = Lists(sets)
    _, name, count = np.unique(grams.flat, return_inverse=True, return_counts=True)
    twice = count[name] > 1
    bound = np.bincount(grams.row[twice], minlength=len(sets))
    open_ = bound >= threshold * size
    grams.keep(twice & open_[grams.row])
    earlier = Lists(groups)
    for a in range(0, len(sets), block):
        b = min(a + block, len(sets))
        if grams.first[a] == grams.first[b]:
            continue
        for c in range(a, len(sets), block):
            d = min(c + block, len(sets))
            common = grams.common(a, b, c, d)
            j = common / (size[a:b, None] + size[None, c:d] - common)
            p, q = np.nonzero(j >= threshold - 1e-6)
            p, q = p + a, q + c
            ok = p < q if side is None else (p < q) & (side[p] != side[q])
            p, q = p[ok], q[ok]
            if len(p):
                met = earlier.common(a, b, c, d)[p - a, q - c] > 0
                p, q = p[~met], q[~met]
            shared = common[p - a, q - c].astype(np.int64)
            exact = shared / (size[p] + size[q] - shared)
            ok = exact >= threshold
            yield p[ok], q[ok], exact[ok]


def linked(sets: list[np.ndarray], size: np.ndarray, groups: list[np.ndarray], side: np.ndarray | None, copies: np.ndarray, threshold: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(links of each place, the smallest place that links lead to): the pairs of :func:`similar`, counted but not listed.

    Two members that lack ``r`` and ``s`` of the group's core, the grams of more
    than half of its members, have all but ``r + s`` of the core in common.
    Members are put in order of what they lack, so whole blocks are known to
    reach the threshold with each other and are counted without a comparison.
    """
    grams = Lists(sets)
    _, name, count = np.unique(grams.flat, return_inverse=True, return_counts=True)
    twice = count[name] > 1
    open_ = np.flatnonzero(np.bincount(grams.row[twice], minlength=len(sets)) >= np.maximum(threshold * size, 1))
    links, low = np.zeros(len(sets), np.int64), np.arange(len(sets))
    if len(open_) < 2:
        return links, low
    names = [name[a:b][twice[a:b]] for a, b in zip(grams.first[open_], grams.first[open_ + 1])]
    core = np.bincount(np.concatenate(names), minlength=len(count)) * 2 > len(open_)
    lack = core.sum() - np.array([core[n].sum() for n in names])
    # two members reach the threshold for sure if their numbers add up to no more than the core
    least = lack + size[open_] * (threshold / (1 + threshold))
    met = np.array([len(groups[p]) > 0 for p in open_])
    order = np.lexsort((open_, least, met))
    place, least, met = open_[order], least[order], met[order]
    n = len(place)
    grams, earlier = Lists([names[k] for k in order]), Lists([groups[p] for p in place])
    size, weight, one_side = size[place], copies[place].astype(np.float64), side is None
    side = None if one_side else side[place]
    found, label = np.zeros(n, np.int64), np.arange(n)
    starts = range(0, n, block)
    most = [least[a : a + block].max() for a in starts]
    mixed = [met[a : a + block].any() for a in starts]
    for i, a in enumerate(starts):
        b = min(a + block, n)
        for j in range(i, len(starts)):
            c, d = j * block, min((j + 1) * block, n)
            sure = most[i] + most[j] <= core.sum() - 1e-6
            if sure and i < j and one_side and not (mixed[i] and mixed[j]):
                found[a:b] += int(weight[c:d].sum())
                found[c:d] += int(weight[a:b].sum())
                if (label[a:b] != label[c]).any() or (label[c:d] != label[c]).any():
                    label = roots(n, label[np.r_[a:b, c:d]], np.repeat(label[c], b - a + d - c))[label]
                continue
            pair = np.ones((b - a, d - c), bool) if one_side else side[a:b, None] != side[None, c:d]
            if i == j:
                pair &= np.tri(b - a, k=-1, dtype=bool).T
            if mixed[i] and mixed[j]:
                pair &= earlier.common(a, b, c, d) == 0
                if not pair.any():
                    continue
            if not sure:
                common = grams.common(a, b, c, d).astype(np.float64)
                pair &= common / (size[a:b, None] + size[None, c:d] - common) >= threshold
            found[a:b] += (pair @ weight[c:d]).astype(np.int64)
            found[c:d] += (weight[a:b] @ pair).astype(np.int64)
            new = pair & (label[a:b, None] != label[None, c:d])
            if new.any():
                p, q = np.nonzero(new)
                label = roots(n, label[p + a], label[q + c])[label]
    links[place] = found
    first = np.full(n, len(sets))
    np.minimum.at(first, label, place)
    low[place] = first[label]
    return links, low


def reached(sets: list[np.ndarray], size: np.ndarray, threshold: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, place) of pairs of a group that connect all that its pairs which reach the threshold connect.

    A member found leaves the rest, and only the rest is compared with it, so a
    group that hangs together is not compared with itself in full.
    """
    grams = Lists(sets)
    _, name, count = np.unique(grams.flat, return_inverse=True, return_counts=True)
    twice = count[name] > 1
    open_ = np.bincount(grams.row[twice], minlength=len(sets)) >= threshold * size
    names = [name[a:b][twice[a:b]] for a, b in zip(grams.first[:-1], grams.first[1:])]
    rest = np.flatnonzero(open_ & (size > 0))
    while len(rest) > 1:
        ahead, rest = [int(rest[0])], rest[1:]
        while ahead and len(rest):
            # one at first, then as many as it led to
            some, ahead = ahead[:block], ahead[block:]
            found = []
            for a in range(0, len(rest), block):
                part = rest[a : a + block]
                both = Lists([names[p] for p in [*some, *part]])
                common = both.common(0, len(some), len(some), len(some) + len(part)).astype(np.int64)
                near = common / (size[some][:, None] + size[part][None] - common) >= threshold
                hit = np.flatnonzero(near.any(0))
                if len(hit):
                    found.append(part[hit])
                    yield np.array(some)[near[:, hit].argmax(0)], part[hit]
            if found:
                new = np.concatenate(found)
                ahead += new.tolist()
                rest = np.setdiff1d(rest, new, assume_unique=True)


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest place that the pairs connect each place with."""
    low = np.arange(n)
    while True:
        old = low.copy()
        least = np.minimum(low[p], low[q])
        np.minimum.at(low, p, least)
        np.minimum.at(low, q, least)
        low = low[low]
        if (low == old).all():
            return low


def verify(members: DataFrame, cells: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Open the groups on the sets of their members, each pair in the first group that both are in.

    (a, b, jaccard, links): all pairs if ``kind`` is "pairs"; for "links" pairs that connect what
    is similar (links null) and for each member the number of documents of similar sets (b null); for
    "classes" pairs that connect what is similar alone, so not all pairs of a group are opened.
    """
    form = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()), ("links", pa.int64())])
    n = F.size("grams")
    cells = members.join(cells.hint("merge"), members["rep"] == cells["id"]).select("id", "grps", "copies", "size", "grams")
    weight = cells.select(F.explode("grps").alias("grp"), n.alias("n")).groupBy("grp").agg(F.sum("n").alias("grams"))
    large = weight.where(F.col("grams") > TASK).select("grp", F.ceil(F.col("grams") / TASK).cast("int").alias("blocks"))
    sets = cells.select(F.explode("grps").alias("grp"), "id", "grps", "copies", "size", "grams")
    # a member of block b of a large group goes to each pair of blocks that b is in
    sets = sets.join(large.hint("merge"), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sets = sets.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "grps", "copies", "size", "grams")

    def found(a: np.ndarray, **others: np.ndarray) -> pa.Table:
        """The columns that aren't given are null; ids stay whole numbers."""
        columns = {"a": a, **others}
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(a), f.type) for f in form], schema=form)

    def group(key: tuple, rows: pa.Table) -> pa.Table:
        grp, i, j = (k.as_py() for k in key)
        out = [form.empty_table()]
        if len(rows) > 1:
            rows = rows.sort_by("id").combine_chunks()
            ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
            if kind == "classes":
                return pa.concat_tables([*out, *(found(ids[p], b=ids[q]) for p, q in reached(list(rows["grams"].to_pandas()), rows["size"].to_numpy().astype(np.int64), threshold))])
            grams, groups = (list(rows[c].to_pandas()) for c in ("grams", "grps"))
            args = grams, rows["size"].to_numpy().astype(np.int64), [g[g < grp] for g in groups], rows["mine"].to_numpy() if i < j else None
            if kind == "pairs":
                out += [found(ids[p], b=ids[q], jaccard=s) for p, q, s in similar(*args, threshold)]
            else:
                links, low = linked(*args, copies, threshold)
                on, more = np.flatnonzero(low < np.arange(len(ids))), np.flatnonzero(links)
                out += [found(ids[low[on]], b=ids[on]), found(ids[more], links=links[more])]
        return pa.concat_tables(out)

    return sets.groupBy("grp", "i", "j").applyInArrow(group, "a long, b long, jaccard double, links long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, first): the smallest id of each connected group, by hooking to the smallest neighbour and pointer jumping."""
    links = store.cut(edges.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    both = store.cut(links.union(links.select("b", "a")).distinct())
    label = store.cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("first")))
    while True:
        low = both.join(label.withColumnsRenamed({"id": "b", "first": "near"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        hooked = label.join(low, "id").select("id", "first", F.least("first", "near").alias("new"))
        jump = hooked.select(F.col("id").alias("new"), F.col("new").alias("top"))
        step = store.cut(hooked.join(jump, "new", "left").select("id", "first", F.least("new", F.coalesce("top", "new")).alias("new")))
        changed = not step.where("new <> first").isEmpty()
        label = step.select("id", F.col("new").alias("first"))
        if not changed:
            return label.select(F.col("id").alias("doc_id"), "first")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """``docs`` with one document of each group of similar ones, the smallest id; documents without words or id stay."""
    own, near = _found(docs, threshold, n, "classes")
    edges = near.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
    (name,) = store.fresh(docs, "gone")
    # of equal sets only the smallest id stays, and of those only the smallest of each group
    gone = own.where("doc_id > rep").select(F.col("doc_id").alias(name)).union(components(edges).where("doc_id <> first").select(F.col("doc_id").alias(name)))
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone[name], "left_anti")
