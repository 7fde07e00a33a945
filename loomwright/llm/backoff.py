"""Stupid-backoff scores of documents against the rest of the corpus, computed relationally.

A word is scored by the longest of its n-grams (three words, two, one) that some
other document has: every count is taken without the document's own share, so a
document does not vouch for itself.  Trigrams score c(xyz) / c(xy), bigrams
``ALPHA`` c(yz) / c(y), words ``ALPHA``^2 c(z) / N.

Words are exploded with their two words before (``START`` before the first).
A document's trigrams are partitioned by the hash of their last two words: one
exchange counts trigrams and bigrams together and tells by which a word is
scored.  What is left to know, the count of the context or of the word, is
asked in a second exchange, of the counts that have the same hash.  The counts
of contexts are those of bigrams and words without the ends of documents, where
no word follows; bigrams of one document alone are not asked for and not sent.
Rows of one partition travel as one block of columns (a row of the exchange for
each slice of documents and partition), so neither Spark's rows nor its sort are
paid for each n-gram.

N-grams and contexts that are frequent in a sample of documents are counted over
all documents beforehand; that table is broadcast (the sample grows so that
what it misses fits a task, and the table has at most 4 names for every
``FREQUENT`` / 4 words of it), so rows of a hot bigram are spread by the trigram
and those of a hot trigram by the document.  The corpus is worked through in
``rounds`` hash ranges of the middle word, so that disk is needed for one range
at a time; every range sees all documents.

Cases: null and empty texts (no words) and null ids have no row; rows of the
same id are scored as one document; extra columns are not read; an empty table
has an empty result; texts are read whole, however long; a corpus of one
document scores by word counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import words as W

ALPHA = 0.4
ROUNDS = 3
START = W.U64(0x5354415254)
#: Documents in which frequent n-grams are looked for, at least, and how often they must stand there.
SAMPLE, FREQUENT = 16_384, 64
#: Rows of an exchange that one task holds.
TASK = 1_000_000
#: Words with this share of all words are in the broadcast table.
COMMON = 1 / 1_048_576
_A, _B = W.U64(0x9E3779B97F4A7C15), W.U64(0xC2B2AE3D27D4EB4F)

#: Kinds of blocks, and the columns of each.
TRIGRAM, ASK, CONTEXT_COUNT, ASK_WORD, LAST_COUNT, WORD, WORD_COUNT, GRAM_COUNT, DONE = range(9)
COLUMNS = {
    TRIGRAM: "u8 u8 u8 i8 u4 u4 u4 u4",  # x and y, y, z, document, how often there, and how often there: xy, yz, y
    ASK: "u8 i8 u4 i8 u4",  # xy, document, how often there, trigram's count elsewhere, how often there: xy
    CONTEXT_COUNT: "u8 i8",  # below 0: ends of documents
    ASK_WORD: "u8 i8 u4 i8 u4",  # y, document, how often there, bigram's count elsewhere, how often there: y
    LAST_COUNT: "u8 i8",  # last words of documents
    WORD: "u8 i8 u4",  # z, document, how often there
    WORD_COUNT: "u8 i8",
    GRAM_COUNT: "u8 i8",
    DONE: "i8 u4 u4 f8",  # document, words, of them backed off, their log scores
}
BLOCK = "kind int, part int, rows binary"
#: Blocks of words, of what all ranges have to say before it is known, and of scores, in columns of their own, which are read alone.
LEFT = "kind int, part int, rows binary, later binary, done binary"


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    return W.mix64(a * _A + W.mix64(b + _B))


def _context(h: np.ndarray) -> np.ndarray:
    """A context has a name of its own, apart from the n-gram of its words."""
    return W.mix64(h ^ _B)


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(document's id, x, y, z) of every word z with the two before it, slice by slice."""
    data, off = W.buffers(batch["text"])
    ids = batch["doc_id"].to_numpy(zero_copy_only=False)
    for a, b in W.slices(off):
        s, e, wo = W.spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
        if not len(s):
            continue
        z = W.hashes(data[off[a] : off[b]], s, e)
        y, x = np.full_like(z, START), np.full_like(z, START)
        y[1:], x[2:] = z[:-1], z[:-2]
        place = np.arange(len(z)) - np.repeat(wo[:-1], np.diff(wo))
        y[place < 1] = START
        x[place < 2] = START
        yield np.repeat(ids[a:b], np.diff(wo)), x, y, z


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number of its group by place) of equal keys: one sort of the keys' high bits with the places in the low ones."""
    n = len(key)
    bits = W.U64(n.bit_length())
    packed = np.sort(key >> bits << bits | np.arange(n, dtype=np.uint64))
    order = (packed & ((W.U64(1) << bits) - W.U64(1))).astype(np.int64)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if (new[1:] & (packed[1:] >> bits == packed[:-1] >> bits)).any():  # different keys with equal high bits
        _, first, name = np.unique(key, return_index=True, return_inverse=True)
        return first, name
    name = np.empty(n, np.int64)
    name[order] = np.cumsum(new) - 1
    return order[new], name


def _sums(name: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Integer sums by group."""
    return np.bincount(name, n).astype(np.int64)


def _narrow(c: np.ndarray, t: str) -> tuple[np.ndarray, bytes]:
    """A column in the narrowest type that holds it and what tells so: the width, for i8 the value that stands for 0."""
    if t == "u4":
        c = c.astype("u1" if c.max(initial=0) < 256 else "u4")
        return c, bytes([c.itemsize])
    low, high = (int(c.min()), int(c.max())) if len(c) else (0, 0)
    reach = high - low
    if reach >> 32:
        return c.astype("i8"), bytes([8]) + bytes(8)
    c = (c - low).astype("u2" if reach < 1 << 16 else "u4")
    return c, bytes([c.itemsize]) + low.to_bytes(8, "little", signed=True)


def blocks(kind: int, part: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """The rows as blocks, one for each partition that has any; ``part`` is a hash.

    A block starts with what :func:`_narrow` tells of its u4 and i8 columns.
    """
    part = (part % W.U64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    used, first = np.unique(part[order], return_index=True)
    head, cols = b"", []
    for c, t in zip(columns, COLUMNS[kind].split()):
        c = c.astype(t, copy=False)
        if t in ("u4", "i8"):
            c, told = _narrow(c, t)
            head += told
        cols.append(c[order])
    rows = [b"".join([head, *(c[u:v].tobytes() for c in cols)]) for u, v in zip(first.tolist(), [*first[1:].tolist(), len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int32)), pa.array(used.astype(np.int32)), pa.array(rows, pa.binary())], ["kind", "part", "rows"])


def unpacked(types: list[str], block: bytes) -> list[np.ndarray]:
    """The columns of a block."""
    at, form = 0, []
    for t in types:
        low = 0
        if t == "u4":
            t, at = f"u{block[at]}", at + 1
        elif t == "i8":
            low = int.from_bytes(block[at + 1 : at + 9], "little", signed=True)
            t, at = ("i8" if block[at] == 8 else f"u{block[at]}"), at + 9
        form.append((t, int(t[1]), low))
    n = (len(block) - at) // sum(wide for _, wide, _ in form)
    out = []
    for asked, (t, wide, low) in zip(types, form):
        c = np.frombuffer(block, t, n, at)
        out.append(c if t == asked else c.astype(asked) + low if low else c.astype(asked))
        at += n * wide
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
    """Columns by kind of all blocks of a task, which the number of partitions bounds."""
    got: dict[int, list[bytes]] = {}
    for b in batches:
        for k, r in zip(b["kind"].to_pylist(), b["rows"].to_pylist()):
            got.setdefault(k, []).append(r)
    out = {}
    for k, rows in got.items():
        types = COLUMNS[k].split()
        lists: list[list[np.ndarray]] = [[] for _ in types]
        for r in rows:
            for c, values in zip(lists, unpacked(types, r)):
                c.append(values)
        rows.clear()
        out[k] = [np.concatenate(c) for c in lists]
    return out


def _spread(doc: np.ndarray) -> np.ndarray:
    return W.mix64(doc.view(np.uint64))


def _names(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Contexts y and xy, bigrams yz and trigrams xyz."""
    xy = join(x, y)
    return np.concatenate([_context(y), _context(xy), join(y, z), join(xy, z)])


def frequent(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Names of contexts and n-grams that are frequent in a sample, sorted; slices in which one stands under 4 times don't count for it."""
    most = max(SAMPLE, int(n_docs * 4 * FREQUENT / TASK))
    part = docs if n_docs <= most else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * (most / n_docs)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, y, z in tokens(batch):
                g = np.sort(_names(x, y, z))
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                n = np.diff(np.append(first, len(g)))
                keep = n >= min(4, FREQUENT)
                yield pa.RecordBatch.from_arrays([W.to_long(g[first[keep]]), pa.array(n[keep])], ["gram", "n"])

    # the contexts at the start of a document are no bigrams or words of one, so they are always counted here
    start = np.array([START])
    start = _context(np.concatenate([start, join(start, start)]))
    found = part.mapInArrow(apply, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select("gram").toArrow()["gram"].to_numpy()
    return np.union1d(found.view(np.uint64), start)


def known(hot: Table, x: np.ndarray, y: np.ndarray, z: np.ndarray, first: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Those of :func:`_names` that are in the table; ``first`` and ``name`` are the groups of ``z``.

    A name that is frequent has frequent parts, so only words after a frequent
    one are looked at, and trigrams only where context and bigram are frequent.
    """
    after = np.zeros(len(z), bool)
    after[1:] = (hot.look(_context(z[first])) > 0)[name[:-1]]
    after[y == START] = hot.look(_context(np.array([START])))[0] > 0
    at = np.flatnonzero(after)
    x, y, z = x[at], y[at], z[at]
    xy, yz = join(x, y), join(y, z)
    context = _context(xy)
    c, b = hot.look(context) > 0, hot.look(yz) > 0
    xyz = join(xy[c & b], z[c & b])
    return np.concatenate([_context(y), context[c], yz[b], xyz[hot.look(xyz) > 0]])


class Table:
    """Counts by name; a table of the names' high bits turns away most names that it hasn't."""

    def __init__(self, names: np.ndarray, n: np.ndarray):
        order = np.argsort(names)
        self.names, self.n = names[order], n[order]
        self.shift = W.U64(64 - min(24, max(10, (16 * len(names)).bit_length())))
        self.seen = np.zeros(1 << 64 - int(self.shift), bool)
        self.seen[self.names >> self.shift] = True

    def look(self, names: np.ndarray) -> np.ndarray:
        """Counts, 0 for names that it hasn't."""
        out = np.zeros(len(names), np.int64)
        if len(self.names):
            maybe = np.flatnonzero(self.seen[names >> self.shift])
            at = np.minimum(np.searchsorted(self.names, names[maybe]), len(self.names) - 1)
            out[maybe] = np.where(self.names[at] == names[maybe], self.n[at], 0)
        return out


def counted(docs: DataFrame, names: np.ndarray, parts: int) -> DataFrame:
    """Blocks of the counts of all words, of the ends of documents, and of those n-grams and contexts in ``names``; ``n`` is the number counted."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Table(shared.value, np.ones(len(shared.value), np.int64))
        for batch in batches:
            for doc, x, y, z in tokens(batch):
                first, name = groups(z)
                yield blocks(WORD_COUNT, z[first], parts, z[first], np.bincount(name))
                last = np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(doc) - 1)
                yield blocks(LAST_COUNT, z[last], parts, z[last], np.ones(len(last), np.int64))
                yz = join(y[last], z[last])
                yield blocks(CONTEXT_COUNT, yz, parts, yz, np.full(len(last), -1))
                if len(shared.value):
                    g = known(hot, x, y, z, first, name)
                    if len(g):
                        first, name = groups(g)
                        yield blocks(GRAM_COUNT, g[first], parts, g[first], np.bincount(name))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (g, n) in gathered(batches).items():
            first, name = groups(g)
            n = _sums(name, n)
            b = blocks(kind, g[first], parts, g[first], n)
            total = [int(unpacked(COLUMNS[kind].split(), r)[1].sum()) for r in b["rows"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total, pa.int64())], [*b.schema.names, "n"])

    return docs.mapInArrow(apply, BLOCK).repartitionById(parts, "part").mapInArrow(add, BLOCK + ", n long")


def listed(counts: DataFrame, kind: int, least: float = 0) -> Table:
    """The counts of a kind, from ``least`` on; for what is bounded."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in gathered(batches).values():
            yield pa.RecordBatch.from_arrays([W.to_long(g[n >= least]), pa.array(n[n >= least])], ["gram", "n"])

    got = counts.where(F.col("kind") == kind).select("kind", "rows").mapInArrow(apply, "gram long, n long").toArrow()
    return Table(got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy())


def trigrams(docs: DataFrame, table, part: int, rounds: int, parts: int) -> DataFrame:
    """Blocks of the documents' trigrams whose middle word is in range ``part``, by their last two words; those of a hot bigram by trigram, of a hot trigram by document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = table.value["grams"]
        for batch in batches:
            for doc, x, y, z in tokens(batch):
                use = np.flatnonzero(y % W.U64(rounds) == W.U64(part))
                if not len(use):
                    continue
                doc, x, y, z = doc[use], x[use], y[use], z[use]
                mine = W.mix64(doc.view(np.uint64) + _A)  # n-grams of one document are apart from those of another
                xy, yz = join(x, y), join(y, z)
                first, name = groups(join(xy, z) ^ mine)
                order = np.argsort(first)
                first, k = first[order], np.bincount(name)[order]
                own, own_b, own_y = (np.bincount(n)[n[first]] for n in (groups(h ^ mine)[1] for h in (xy, yz, y)))
                doc, xy, y, z, key = doc[first], xy[first], y[first], z[first], yz[first]
                if len(at := np.flatnonzero(hot.look(key))):
                    g = join(xy[at], z[at])
                    key[at] = np.where(hot.look(g) > 0, _spread(doc[at]), g)
                yield blocks(TRIGRAM, W.mix64(key), parts, xy, y, z, doc, k, own, own_b, own_y)

    return docs.mapInArrow(apply, BLOCK)


def _done(scored: list[tuple[np.ndarray, np.ndarray, bool, np.ndarray]], parts: int) -> pa.RecordBatch:
    """A row for each document of (document, how often there, by less than a trigram, log score)."""
    doc = np.concatenate([d for d, _, _, _ in scored])
    first, name = groups(_spread(doc))
    n, less = (_sums(name, np.concatenate(c)) for c in zip(*((k, k * less) for _, k, less, _ in scored)))
    return blocks(DONE, _spread(doc[first]), parts, doc[first], n, less, np.bincount(name, np.concatenate([k * lp for _, k, _, lp in scored])))


def score_trigrams(table, parts: int, size: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)
        if not got:
            return
        hot, common = table.value["grams"], table.value["words"]
        xy, y, z, doc, k, own, own_b, own_y = got.pop(TRIGRAM)
        g = join(xy, z)
        first, name = groups(g)
        c = hot.look(g[first])
        n3 = np.where(c > 0, c, _sums(name, k))[name] - k
        del g
        b = join(y, z)
        first, name = groups(b)
        b, n = b[first], _sums(name, k)
        c = hot.look(b)
        n2 = np.where(c > 0, c, n)[name] - own_b
        # a context is asked for where another document goes on like this one, so it stands in both
        ask = (n2[first] > 0) & (hot.look(_context(b)) == 0)
        if ask.any():
            yield blocks(CONTEXT_COUNT, b[ask], parts, b[ask], n[ask])
        del first, name, b, n, c
        scored = []
        for kind, at, context, n, mine, alpha in ((ASK, n3 > 0, xy, n3, own, 1), (ASK_WORD, (n3 <= 0) & (n2 > 0), y, n2, own_y, ALPHA)):
            at = np.flatnonzero(at)
            c = hot.look(_context(context[at]))
            ready, at = at[c > 0], at[c == 0]
            scored.append((doc[ready], k[ready], kind == ASK_WORD, np.log(alpha * n[ready] / (c[c > 0] - mine[ready]))))
            if len(at):
                yield blocks(kind, context[at], parts, context[at], doc[at], k[at], n[at], mine[at])
        at = np.flatnonzero((n3 <= 0) & (n2 <= 0))
        c = common.look(z[at])
        ready, at = at[c > 0], at[c == 0]
        scored.append((doc[ready], k[ready], True, np.log(ALPHA * ALPHA * c[c > 0] / size)))
        if len(at):
            yield blocks(WORD, z[at], parts, z[at], doc[at], k[at])
        yield _done(scored, parts)

    return apply


def apart(apply):
    """The blocks of ``apply`` as :data:`LEFT`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in apply(batches):
            if b.num_rows:
                kind, part, rows = b.columns
                columns = [pa.nulls(b.num_rows, pa.binary())] * 3
                columns[{ASK: 1, CONTEXT_COUNT: 1, DONE: 2}.get(kind[0].as_py(), 0)] = rows
                yield pa.RecordBatch.from_arrays([kind, part, *columns], ["kind", "part", "rows", "later", "done"])

    return run


def score_rest(parts: int, size: int):
    """Scores of the words that ask for a count, which is in the same partition."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)

        def total(kind: int, asked: np.ndarray) -> np.ndarray:
            if kind not in got:
                return np.zeros(len(asked), np.int64)
            names, n = got[kind]
            first, name = groups(names)
            return Table(names[first], _sums(name, n)).look(asked)

        scored = []
        if ASK in got:
            xy, doc, k, n, own = got.pop(ASK)
            scored.append((doc, k, False, np.log(n / (total(CONTEXT_COUNT, xy) - own))))
        if ASK_WORD in got:
            y, doc, k, n, own = got.pop(ASK_WORD)
            scored.append((doc, k, True, np.log(ALPHA * n / (total(WORD_COUNT, y) - total(LAST_COUNT, y) - own))))
        if WORD in got:
            z, doc, k = got.pop(WORD)
            scored.append((doc, k, True, np.log(ALPHA * ALPHA * total(WORD_COUNT, z) / size)))
        if scored:
            yield _done(scored, parts)

    return apply


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc, k, less, lp in gathered(batches).values():
        first, name = groups(_spread(doc))
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(_sums(name, k)), pa.array(_sums(name, less)), pa.array(np.bincount(name, lp))], ["doc_id", "k", "b", "lp"])


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, backed_off, log_score): the sum of the natural logs of the scores of the document's words; ``backed_off`` of them by less than a trigram."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        # rows of one id are one document: its texts follow each other
        docs = store.cut(docs.groupBy("doc_id").agg(F.array_join(F.array_sort(F.array_agg("text")), "\n").alias("text")))
    spark = docs.sparkSession
    about = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts, asked = (max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-about["chars"] // n)) for n in (4 * rounds * TASK, 6 * TASK))
    counts = store.cut(counted(docs, frequent(docs, about["docs"]), asked))
    size = counts.where(F.col("kind") == WORD_COUNT).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    table = spark.sparkContext.broadcast({"grams": listed(counts, GRAM_COUNT), "words": listed(counts, WORD_COUNT, max(1, size * COMMON))})
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds)).select("kind", "part", "rows")
    column = lambda df, c: df.where(F.col(c).isNotNull()).select("kind", "part", F.col(c).alias("rows"))
    asking = lambda df: df.repartitionById(asked, "part").mapInArrow(score_rest(asked, size), BLOCK)
    summed = lambda df: store.cut(df.repartitionById(asked, "part").mapInArrow(_summed, "doc_id long, k long, b long, lp double"), outer=True)
    words = of(counts, WORD_COUNT, LAST_COUNT)
    with store.scope():
        sums, later = [], of(counts, CONTEXT_COUNT)
        for r in range(rounds):
            with store.scope():
                left = store.cut(trigrams(docs, table, r, rounds, parts).repartitionById(parts, "part").mapInArrow(apart(score_trigrams(table, asked, size)), LEFT))
                later = later.union(store.cut(column(left, "later"), outer=True))
                sums.append(summed(column(left, "done").union(asking(column(left, "rows").union(words)))))
        out = summed(asking(later))
        for p in sums:
            out = out.union(p)
        out = store.cut(out, outer=True)
    return out.groupBy("doc_id").agg(F.sum("k").alias("n_words"), F.sum("b").alias("backed_off"), F.sum("lp").alias("log_score"))


def oracle(documents: str = "documents") -> str:
    """The same in DuckDB SQL, with the score by word."""
    count = lambda *c: f"count(*) OVER (PARTITION BY {', '.join(c)}) - count(*) OVER (PARTITION BY doc_id, {', '.join(c)})"
    return f"""
WITH w AS (
  SELECT doc_id, unnest(words) AS z, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\t\\n\\f\\r ]+') AS words FROM {documents} WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
g AS (SELECT doc_id, z, coalesce(lag(z) OVER d, ' ') AS y, coalesce(lag(z, 2) OVER d, ' ') AS x FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (
  SELECT doc_id, {count("x", "y", "z")} AS c3, {count("x", "y")} AS d3, {count("y", "z")} AS c2, {count("y")} AS d2,
    count(*) OVER (PARTITION BY z) AS c1, count(*) OVER () AS d1
  FROM g)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (c3 = 0) AS backed_off,
  round(sum(CASE WHEN c3 > 0 THEN ln(c3 / d3) WHEN c2 > 0 THEN ln({ALPHA} * c2 / d2) ELSE ln({ALPHA} * {ALPHA} * c1 / d1) END) / count(*), 6) AS score
FROM n GROUP BY doc_id"""
