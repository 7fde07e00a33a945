"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import collections
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import automaton, backoff, bpe, edits, jaccard, langid, mixing, neighbours, quality, repeats, rindex, store
from loomwright.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYL = "an er ing on the re st ou nd ly".split()


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYL) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def table(spark, texts, extra=None):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra or [])])


@pytest.fixture(scope="module")
def corpus():
    """Prose with exact copies, near copies, shared passages, nulls, blanks, a long text and a repeated word."""
    rng = random.Random(3)
    texts = [" ".join(prose(rng, rng.randint(3, 300))) for _ in range(60)]
    passage = prose(rng, 60)
    for k in (5, 9, 14, 30, 41):
        w = texts[k].split()
        texts[k] = " ".join(w[: len(w) // 2] + passage + w[len(w) // 2 :])
    texts += [texts[3], texts[3], texts[14], texts[20] + "\n", "", None, "   \n ", "a", "x " * 500, "x " * 400]
    near = texts[33].split()
    near[5 : 8] = ["changed"] * 3
    texts += [" ".join(near), " ".join(prose(rng, 40_000)), texts[5][:-3], "été 中文 \U0001f600 nul\x00l"]
    return texts


CLASH = ["seed", "at", "rep", "size", "gram", "grp", "id", "first", "quality_score", "mix_p", "token_ids", "lang_id", "cut_id", "cuts", "gone", "cell_s", "band", "word", "ctx", "start_word"]


def spans_by_hand(texts, least):
    first, words = {}, {i: (t or "").split(" ") and (t or "").replace("\n", " ").split(" ") for i, t in enumerate(texts)}
    words = {i: [x for x in w if x] for i, w in words.items()}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            first.setdefault(tuple(w[k : k + least]), i)
    out = set()
    for i, w in words.items():
        flag = np.zeros(len(w), bool)
        for k in range(len(w) - least + 1):
            if first[tuple(w[k : k + least])] < i:
                flag[k : k + least] = True
        out |= {(i, a, b - a) for a, b in repeats.runs_of(flag)}
    return out


@pytest.mark.parametrize("op", [automaton, rindex])
@pytest.mark.parametrize("least", [25, 50])
def test_repeats(spark, corpus, op, least):
    docs = table(spark, corpus, CLASH)
    got = {tuple(r) for r in op.repeated(docs, least).select("doc_id", "start_word", "n_words").collect()}
    assert got == spans_by_hand(corpus, least)
    left = op.deduplicate(docs, least)
    assert left.columns == docs.columns
    new = {r["doc_id"]: r for r in left.collect()}
    touched = {d for d, _, _ in got}
    for i, t in enumerate(corpus):
        if i not in touched:
            assert new[i]["text"] == t
        elif i in new:
            assert new[i]["n_chars"] == len(new[i]["text"]) < len(t)
    assert 60 not in new and 61 not in new  # copies of 3 as a whole
    assert 3 in new


def test_repeats_of_empty_table(spark, corpus):
    for op in (automaton, rindex):
        assert op.repeated(spark.createDataFrame([], SCHEMA)).count() == 0
        assert op.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_null_ids(spark, corpus):
    docs = table(spark, corpus[:20])
    twice = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert automaton.repeated(twice).count() == automaton.repeated(docs).count()
    assert rindex.deduplicate(twice).where("doc_id is null").count() == 20


def test_automaton_and_index_statistics():
    rng = np.random.default_rng(1)
    for _ in range(20):
        ref, q = rng.integers(0, 3, 80), rng.integers(0, 3, 40)
        auto = automaton.Automaton()
        auto.add(ref.tolist())
        text = np.concatenate([ref, [-1]])
        length, place = rindex.RunIndex(text).statistics(q)
        r = ref.tolist()
        has = lambda s: any(r[i : i + len(s)] == s for i in range(len(r) - len(s) + 1))
        ending = [max(n for n in range(k + 2) if has(q[k + 1 - n : k + 1].tolist())) for k in range(len(q))]
        starting = [max(n for n in range(len(q) - k + 1) if has(q[k : k + n].tolist())) for k in range(len(q))]
        assert auto.statistics(q.tolist()) == ending
        assert length.tolist() == starting
        for k in range(len(q)):
            assert text[place[k] : place[k] + length[k]].tolist() == q[k : k + length[k]].tolist()


def test_broadcast_reference(spark, corpus):
    ref = spark.createDataFrame([(0, " ".join(corpus[5].split()[:80])), (1, None)], "item_id long, text string")
    got = {r["doc_id"] for r in automaton.against(table(spark, corpus), ref, 30, shard_bytes=100).collect()}
    assert 5 in got and 2 not in got


def jaccard_by_hand(texts, n=3):
    sets = {}
    for i, t in enumerate(texts):
        w = [x for x in (t or "").replace("\n", " ").split(" ") if x]
        if w:
            sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def test_jaccard(spark, corpus):
    docs = table(spark, corpus, CLASH)
    true = jaccard_by_hand(corpus)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.pairs(docs).collect()}
    assert all(abs(true[p] - j) < 1e-12 for p, j in got.items())
    groups = lambda pairs: {frozenset(g) for g in _components(pairs)}
    # pairs of different sets are between their smallest ids, copies are linked to those
    rep = {}
    for (a, b), j in sorted(true.items()):
        if j == 1:
            rep[b] = min(rep.get(b, b), a)
    assert set(got) == {(a, b) for a, b in true if (a not in rep and b not in rep) or rep.get(b) == a}
    rows = {r["doc_id"]: r for r in jaccard.classes(docs).collect()}
    links = collections.Counter(x for p in true for x in p)
    assert {d: r["links"] for d, r in rows.items()} == dict(links)
    assert {d: r["class_id"] for d, r in rows.items()} == {x: min(g) for g in groups(true) for x in g}
    assert all(r["same_as"] == rep.get(d, d) for d, r in rows.items())
    assert jaccard.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    gone = {x for g in groups(true) for x in g if x != min(g)}
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(corpus))) - gone
    assert jaccard.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def _components(pairs):
    group = {}
    for a, b in pairs:
        merged = group.get(a, {a}) | group.get(b, {b})
        for x in merged:
            group[x] = merged
    return list(group.values())


def test_jaccard_recall(spark):
    """Pairs at all similarities above the threshold, many documents with one passage."""
    rng = random.Random(9)
    passage = prose(rng, 60)
    texts = []
    for k in range(150):
        w = prose(rng, rng.randint(80, 400))
        v = list(w)
        for p in range(len(v)):
            if rng.random() < 0.08:
                v[p] = prose(rng, 1)[0]
        texts += [" ".join(w), " ".join(v), " ".join(prose(rng, rng.randint(60, 150)) + passage)]
    true = jaccard_by_hand(texts)
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.pairs(table(spark, texts)).collect()}
    assert len(true) > 100
    assert got <= set(true)
    assert len(got) >= 0.99 * len(true)


def test_jaccard_blocks_of_a_large_group(spark, monkeypatch):
    """A group that is cut into blocks links what the whole group links."""
    rng = random.Random(17)
    w = prose(rng, 120)
    texts = []
    for _ in range(60):
        v = list(w)
        for p in rng.sample(range(120), 6):
            v[p] = prose(rng, 1)[0] + "x"
        texts.append(" ".join(v))
    texts += texts[:20]
    docs = table(spark, texts)
    whole = {tuple(r) for r in jaccard.classes(docs).collect()}
    monkeypatch.setattr(jaccard, "TASK", 1000)
    assert {tuple(r) for r in jaccard.classes(docs).collect()} == whole
    links = collections.Counter(x for p in jaccard_by_hand(texts) for x in p)
    assert sum(r[3] for r in whole) >= 0.99 * sum(links.values())


def test_jaccard_recall_with_differing_long_tokens(spark):
    """Near copies that differ in nothing but long tokens."""
    rng = random.Random(31)
    texts = []
    for n in (300, 1000, 2000) * 8:
        w = prose(rng, n)
        for _ in range(2):
            v = list(w)
            for p in range(16):
                v[p * n // 16] = "https://a.example/" + "".join(rng.choice("0123456789abcdef") for _ in range(60))
            texts.append(" ".join(v))
    true = jaccard_by_hand(texts)
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.pairs(table(spark, texts)).collect()}
    assert len(true) == 24
    assert got <= set(true) and len(got) >= 0.95 * len(true)


def near_threshold(rng, least, most):
    """Pairs of texts around the threshold, alike by frequent passages alone."""
    shared = [prose(rng, 12) for _ in range(60)]
    texts = []
    for _ in range(150):
        w = [x for p in rng.sample(shared, rng.randint(6, 20)) for x in p]
        own = rng.randint(least * len(w) // 100, most * len(w) // 100)
        texts += [" ".join(prose(rng, own // 2) + w + prose(rng, own - own // 2)) for _ in range(2)]
    return texts


def excerpts(rng, pairs=6, lines=400):
    """Lines, and pairs of texts made of the same lines with a word of their own between them."""
    books = [[prose(rng, 8) for _ in range(lines)] for _ in range(pairs)]
    texts = [" ".join(line) for book in books for line in book]
    return texts + [" ".join(w for line in book for w in [*line, f"{rng.random()}"]) for book in books for _ in range(2)]


def test_jaccard_finds_every_pair(spark):
    """No link is left out, of pairs that barely reach the threshold and of those alike by lines of many others."""
    rng = random.Random(41)
    texts = excerpts(rng) + near_threshold(rng, 25, 52)
    true = jaccard_by_hand(texts)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.pairs(table(spark, texts)).collect()}
    assert len(true) > 100 and sum(j < 0.55 for j in true.values()) > 20
    assert set(got) == set(true) and all(abs(true[p] - j) < 1e-12 for p, j in got.items())


def test_jaccard_in_parts(spark, monkeypatch):
    """Many parts and slices, ids of any sign and distance, frequent grams: the same pairs."""
    rng = random.Random(43)
    texts = near_threshold(rng, 25, 52) + ["a b c d"] * 3 + ["a b", "a b ", "a"]
    ids = [rng.choice([k, -k - 1, k << 40, k - (1 << 63), (1 << 63) - 1 - k]) for k in range(len(texts))]
    ids = dict(enumerate(dict.fromkeys(ids)))
    assert len(ids) == len(texts)
    monkeypatch.setattr(jaccard, "PART", 1 << 14)
    monkeypatch.setattr(jaccard, "SLICE", 1 << 12)
    got = jaccard.classes(spark.createDataFrame([(ids[k], t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    links = collections.Counter(ids[x] for p in jaccard_by_hand(texts) for x in p)
    assert {r["doc_id"]: r["links"] for r in got} == dict(links)


def test_bpe_is_the_public_encoding(spark, corpus):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.VOCABULARY)
    known.encode_special_tokens = True
    texts = [*corpus, "it's we'll 'tis\n\n x \n", "don't're '' 's ''s \t\ttab", "aaaa aaaaaaa", "<|endoftext|>", " x y  z", "12٣½ !?"]
    rows = {r["doc_id"]: r for r in bpe.encode_documents(table(spark, texts, CLASH)).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i]["token_ids"] is None and rows[i]["round_trip"] is None
        else:
            assert rows[i]["token_ids"] == known.encode(t, add_special_tokens=False).ids
            assert rows[i]["round_trip"] and rows[i]["n_tokens"] == len(rows[i]["token_ids"])
    back = bpe.decode_documents(bpe.encode_documents(table(spark, texts), keep_text=False))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixing(spark, corpus):
    docs = table(spark, corpus, CLASH)
    rows = mixing.weigh(docs).collect()
    total = sum(r["mix_tokens"] for r in rows)
    assert sum(r["mix_tokens"] for r in rows) == sum(len([x for x in (t or "").replace("\n", " ").split(" ") if x]) for t in corpus)
    assert abs(sum(r["mix_tokens"] * r["mix_p"] for r in rows) - mixing.SHARE * total) < 1e-6 * total
    drawn = mixing.sample(docs)
    assert drawn.columns == docs.columns
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r["doc_id"] for r in mixing.sample(docs.repartition(3)).collect())
    assert mixing.sample(spark.createDataFrame([], SCHEMA)).count() == 0


def test_raking_fits_the_marginals():
    rng = np.random.default_rng(2)
    cells = [[f"s{i}" for i in range(3) for _ in range(8)], [f"l{i % 2}" for i in range(24)], [i // 2 % 4 for i in range(24)]]
    n = rng.integers(1, 100, 24).astype(float)
    goal = [{"s0": 0.5, "s1": 0.3, "s2": 0.2}, {"l0": 0.6, "l1": 0.4}, {0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}]
    w = mixing.rake(cells, n, goal, 200)
    for k in range(3):
        for key, want in goal[k].items():
            assert abs(sum(x for c, x in zip(cells[k], w) if c == key) - want) < 1e-9


def test_factorisation_identity():
    d, f, x = quality.features(pa.array(["One two! three", None, "", "AB " * 50]), ["en", None, "", "de"], ["a", "b", None, "a"])
    rng = np.random.default_rng(0)
    m = {"w0": 0.3, "w": rng.normal(size=quality.WIDTH), "v": rng.normal(size=(quality.WIDTH, 4))}
    got = quality.score(m, d, f, x, 4)
    for i in range(4):
        ff, xx = f[d == i], x[d == i]
        want = m["w0"] + (m["w"][ff] * xx).sum()
        for a in range(len(ff)):
            for b in range(a):
                want += m["v"][ff[a]] @ m["v"][ff[b]] * xx[a] * xx[b]
        assert abs(got[i] - want) < 1e-9


def test_quality(spark, corpus):
    rng = random.Random(5)
    good = [" ".join(prose(rng, 80)) + "." for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80)) for _ in range(100)]
    rude = [" ".join(prose(rng, 40) + ["vile", "oaf"] + prose(rng, 40)) for _ in range(100)]
    docs = table(spark, good + bad + rude)
    labels = spark.createDataFrame([(i, int(i < 300 or i >= 400), int(i >= 400)) for i in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    right = [r["quality_keep"] == (r["doc_id"] < 300) for r in rows if r["doc_id"] % 2]
    assert np.mean(right) > 0.95  # none of these was labelled
    odd = table(spark, corpus, CLASH)
    kept = quality.kept(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert quality.classify(odd, labels.limit(0)).where("quality_keep").count() == len(corpus)
    assert quality.classify(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_language(spark, corpus):
    rng = random.Random(6)
    other = "ung sch ei ver ge ch te ber zu lich".split()
    texts, langs = [], []
    for k in range(400):
        s = SYL if k % 2 else other
        texts.append(" ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(60)))
        langs.append("en" if k % 2 else "de")
    texts += ["", None, "?!", "中文中文中 文中文" * 20]
    rows = [(i, t, langs[i] if i < 400 else None, "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang_id", F.lit(3))
    got = {r["doc_id"]: r for r in langid.identify(docs, 100).collect()}
    assert sum(got[i]["lang_id"] == langs[i] for i in range(400)) >= 396
    assert all(got[i]["lang_id"] == "und" and not got[i]["lang_accepted"] for i in range(400, 404))
    assert {r["lang_id"] for r in langid.identify(table(spark, corpus).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kneser_ney_sums_to_one_and_matches_recursion():
    sym = np.random.default_rng(4).integers(1, 9, 4000).astype(np.uint8)
    code, _ = langid._grams(sym, np.array([0, len(sym)]))
    model = langid._kneser_ney(np.unique(code, return_counts=True))
    for ctx in np.unique(code >> 6)[:20]:
        every = (np.uint32(ctx) << np.uint32(6)) | np.arange(64, dtype=np.uint32)
        assert abs(np.exp(langid.log_prob(model, every)).sum() - 1) < 1e-9


def test_backoff(spark, corpus, monkeypatch):
    docs = table(spark, corpus, CLASH)
    words = {i: [x for x in (t or "").replace("\n", " ").split(" ") if x] for i, t in enumerate(corpus)}
    pad = {i: list(zip([None, None, *w], [None, *w], w)) for i, w in words.items()}
    keys = {"xyz": lambda t: t, "xy": lambda t: t[:2], "yz": lambda t: t[1:], "y": lambda t: t[1], "z": lambda t: t[2]}
    own = {i: {k: collections.Counter(map(f, p)) for k, f in keys.items()} for i, p in pad.items()}
    all_ = {k: sum((own[i][k] for i in own), collections.Counter()) for k in keys}
    total = sum(all_["z"].values())

    def score(i, t):
        n = {k: all_[k][f(t)] - own[i][k][f(t)] for k, f in keys.items()}
        return np.log(n["xyz"] / n["xy"]) if n["xyz"] else np.log(0.4 * n["yz"] / n["y"]) if n["yz"] else np.log(0.16 * all_["z"][t[2]] / total)

    for frequent in (backoff.FREQUENT, 3):  # 3: most n-grams are counted beforehand
        monkeypatch.setattr(backoff, "FREQUENT", frequent)
        got = {r["doc_id"]: r for r in backoff.score(docs, 2).collect()}
        assert set(got) == {i for i, w in words.items() if w}
        for i, r in got.items():
            want = sum(score(i, t) for t in pad[i])
            assert abs(r["log_score"] - want) < 1e-6 * max(1, abs(want)) and r["n_words"] == len(words[i])
            assert r["backed_off"] == sum(all_["xyz"][t] == own[i]["xyz"][t] for t in pad[i])
    assert backoff.score(spark.createDataFrame([], SCHEMA)).count() == 0
    one = backoff.score(table(spark, ["a b a b", None])).collect()
    assert [(r["n_words"], r["backed_off"]) for r in one] == [(4, 4)]
    twice = table(spark, corpus[:5]).union(table(spark, corpus[:1])).union(table(spark, corpus[:3]).withColumn("doc_id", F.lit(None).cast("long")))
    assert {r["doc_id"]: r["n_words"] for r in backoff.score(twice).collect()} == {i: len(words[i]) * (2 if i == 0 else 1) for i in range(5)}


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x[3] = x[2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (None, x[0].tolist()), (2003, [1.0, 2.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -9)
    true = {(i, j) for i in range(1500) for j in np.argsort(-g[i])[:10]}
    for cell in (1 << 16, 256):  # one cell, several
        got = neighbours.search(df, 10, leaf=16, cell=cell).collect()
        assert len({(r["id"], r["neighbour"]) for r in got} & true) >= 0.9 * len(true)
        assert max(collections.Counter(r["id"] for r in got).values()) == 10
        assert {r["id"] for r in got} == set(range(1500))
    some = neighbours.search(df, 10, asked=F.col("id") % 20 == 0).collect()
    assert {r["id"] for r in some} == set(range(0, 1500, 20))
    assert len({(r["id"], r["neighbour"]) for r in some} & true) >= 0.9 * 750
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id = 1")).count() == 0


def test_neighbours_equal_vectors(spark):
    """A third of the rows hold one vector: its rows list each other, smallest ids first."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, 5, leaf=16, cell=128).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["id"]].append(r["neighbour"])
    assert found[0] == [3, 6, 9, 12, 15] and found[6] == [0, 3, 9, 12, 15] and found[897] == [0, 3, 6, 9, 12]
    assert all(len(v) == 5 for v in found.values()) and len(found) == 900
    assert neighbours.search(df.where("vec_id % 3 = 0"), 5).count() == 1500


def test_edit_distance():
    rng = random.Random(1)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(200):
        a = [rng.randint(0, 2) for _ in range(rng.randint(0, 12))]
        b = [rng.randint(0, 2) for _ in range(rng.randint(0, 12))]
        d = slow(a, b)
        assert edits.distance(np.array(a), np.array(b), 12) == d
        assert edits.distance(np.array(a), np.array(b), d - 1) is None


def test_bounds_hold_the_distance():
    rng = random.Random(4)
    for _ in range(60):
        a = prose(rng, rng.randint(2, 120))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            b[rng.randrange(len(b))] = prose(rng, 1)[0]
        s, t = (np.frombuffer(" ".join(x).encode("utf-32-le"), np.uint32) for x in (a, b if rng.random() < 0.8 else prose(rng, 60)))
        d = edits.distance(s, t, 10_000)
        assert edits.at_most(s, edits._grams(s), t, edits._grams(t)) >= d
        for most in (3, 30, 300):
            assert edits.distance(s, t, most) is None or edits.at_least([(s, t, most)] * 3).tolist() == [edits.at_least([(s, t, most)])[0]] * 3
            assert d > most or edits.at_least([(s, t, most)])[0] <= d


def test_words_hashed_in_pieces(monkeypatch):
    rng = random.Random(9)
    data = np.frombuffer(" ".join("ab\u00e9"[rng.randrange(3)] * rng.randint(1, 90) for _ in range(3000)).encode(), np.uint8)
    s, e, _ = W.spans(data, np.array([0, len(data)]))
    lengths = []
    total = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda a, *r, **k: (lengths.append(len(a)), total(a, *r, **k))[1])
    whole = W.hashes(data, s, e)
    assert len(data) > 2 * W.CHUNK >= 2 * max(lengths)
    monkeypatch.setattr(W, "CHUNK", 64)
    assert (W.hashes(data, s, e) == whole).all()
    assert [int(h) for h in whole[:50]] == [int(W.hashes(data[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in zip(s[:50], e[:50])]


def test_frequent_names_are_looked_up_by_parts():
    rng = np.random.default_rng(2)
    for _ in range(5):
        z = W.mix64(rng.zipf(1.3, 4000).astype(np.uint64))
        y, x = np.full_like(z, backoff.START), np.full_like(z, backoff.START)
        y[1:], x[2:] = z[:-1], z[:-2]
        for k in rng.integers(0, 3998, 40):
            y[k], x[k], x[k + 1] = backoff.START, backoff.START, backoff.START
        g = backoff._names(x, y, z)
        names, n = np.unique(g, return_counts=True)
        hot = backoff.Table(names[n >= 9], n[n >= 9])
        looked = []
        look = hot.look
        hot.look = lambda h: (looked.append(len(h)), look(h))[1]
        found = backoff.known(hot, x, y, z, *backoff.groups(z))
        assert sorted(found.tolist()) == sorted(g[look(g) > 0].tolist())
        assert sum(looked) < 0.7 * len(g)


def test_distances_left_by_their_bounds(monkeypatch):
    rng = random.Random(8)
    pairs = []
    for k in range(160):
        a = [rng.randint(97, 97 + rng.randint(2, 25)) for _ in range(rng.randint(300, 700))]
        b = list(a)
        for _ in range(int(len(a) * rng.choice([0.03, 0.15, 0.25, 0.5]))):
            b[rng.randrange(len(b))] = rng.randint(97, 122)
        if k % 4 == 0:
            b = b[k // 4 :] + b[: rng.randint(0, k // 4)]
        if k % 5 == 0:
            b = rng.sample(b, len(b))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32), int(rng.choice([0.1, 0.15, 0.3]) * max(len(a), len(b)))))
    alone = [edits._columns(*p) for p in pairs]
    assert 20 < sum(e is None for e in alone) < 140
    assert edits._wave(pairs).tolist() == [-1 if e is None else e for e in alone]
    for (a, b, most), e in zip(pairs, alone):
        assert e is None or not edits.apart(a, b, most, {}, {})
        assert edits.at_most(a, edits._grams(a, 24), b, edits._grams(b, 24), 24) >= edits.distance(a, b, 10_000)
    assert sum(edits.apart(a, b, most, {}, {}) for a, b, most in pairs) > 20
    # most cells of pairs far apart aren't worked out
    steps = []
    count = np.bitwise_and
    monkeypatch.setattr(np, "bitwise_and", lambda *a, **k: (steps.append(a[0].size), count(*a, **k))[1])
    far = [(a, b, 10 + int(0.15 * len(a))) for a, b in ((np.array([rng.randint(97, 122) for _ in range(3000)], np.uint32) for _ in range(2)) for _ in range(8))]
    assert (edits._wave(far) == -1).all()
    assert sum(steps) < 8 * 3000 * 4


def test_members_reached_without_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    done = []
    common = jaccard.Lists.common
    monkeypatch.setattr(jaccard.Lists, "common", lambda self, a, b, c, d: (done.append((b - a) * (d - c)), common(self, a, b, c, d))[1])
    for copies, most in ((400, 0.1), (12, 1)):
        sets = []
        for _ in range(4 if copies < 400 else 1):
            base = rng.integers(0, 1 << 40, 60)
            for _ in range(copies):
                other = rng.random(60) < rng.uniform(0, 0.3 if copies == 400 else 0.5)
                sets.append(np.unique(np.where(other, rng.integers(0, 1 << 40, 60), base)))
        size = np.array([len(s) for s in sets])
        all_ = [np.concatenate(x) for x in list(zip(*jaccard.similar(sets, size, [np.zeros(0, np.int64)] * len(sets), None, 0.5)))[:2]]
        done.clear()
        some = [np.concatenate(x) for x in zip(*jaccard.reached(sets, size, 0.5, block=16))]
        assert sum(done) < most * len(sets) ** 2
        assert {tuple(sorted(p)) for p in zip(*some)} <= set(zip(*all_))
        assert (jaccard.roots(len(sets), *some) == jaccard.roots(len(sets), *all_)).all()


def test_links_counted_without_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    done = []
    common = jaccard.Lists.common
    monkeypatch.setattr(jaccard.Lists, "common", lambda self, a, b, c, d: (done.append((b - a) * (d - c)), common(self, a, b, c, d))[1])
    for n, most in ((600, 0.2), (80, 1)):
        base = rng.integers(0, 1 << 40, 60)
        sets = []
        for _ in range(n):
            other = rng.random(60) < rng.exponential(0.06 if n == 600 else 0.3)
            sets.append(np.unique(np.where(other, rng.integers(0, 100, 60) + 100 * np.arange(60), base)))
        size = np.array([len(s) for s in sets])
        none = [np.zeros(0, np.int64)] * n
        some = [rng.choice(3, rng.integers(0, 2)).astype(np.int64) if k > n // 2 else none[k] for k in range(n)]
        copies = rng.integers(1, 5, n)
        for groups in (none, some):
            for side in (None, rng.integers(3, 5, n)):
                p, q, _ = (np.concatenate(x) for x in zip(*jaccard.similar(sets, size, groups, side, 0.5)))
                done.clear()
                links, low = jaccard.linked(sets, size, groups, side, copies, 0.5, block=16)
                assert 0 < len(p) < n * (n - 1) / 2
                assert links.tolist() == (np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)).tolist()
                assert (low == jaccard.roots(n, p, q)).all()
                if groups is none:
                    assert sum(done) < most * n**2


def test_distances_of_many_pairs_together():
    rng = random.Random(6)
    pairs = []
    for k in range(300):
        a = [rng.randint(97, 97 + rng.randint(1, 25)) for _ in range(rng.randint(1, 300) if k else 2000)]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 4))):
            p = rng.randrange(len(b))
            b[p : p + rng.randint(0, 1)] = [rng.randint(97, 0x1F600)] * rng.randint(0 if len(b) > 1 else 1, 1)
        s, t = np.array(a, np.uint32), np.array(b, np.uint32)
        pairs.append((s, t, int(rng.choice((0, 0.05, 0.15, 0.4)) * max(len(s), len(t)))))
    alone = [edits.distance(*p) for p in pairs]
    assert edits.together(pairs).tolist() == [-1 if d is None else d for d in alone]
    assert sum(d is None for d in alone) > 50 < sum(d is not None for d in alone)


def test_fingerprint_classes_try_few_pairs(spark, monkeypatch):
    """Classes are those of all links, and a group of near copies isn't compared with itself in full."""
    rng = random.Random(8)
    texts = []
    for size, copies in ((300, 60), (200, 3), (80, 2)):
        base = " ".join(prose(rng, size))
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(1, len(t) // 12)):
                t[rng.randrange(len(t))] = rng.choice("abcdef")
            texts.append("".join(t))
    texts += [texts[5], texts[64], " ".join(prose(rng, 100))]
    docs = table(spark, texts)
    links = [(r["doc_a"], r["doc_b"]) for r in edits.near(docs).collect()]
    want = {k: k for k in range(len(texts))}
    for _ in texts:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    on = {i for p in links for i in p}
    asked = []
    within = edits._within
    monkeypatch.setattr(edits, "_within", lambda docs, pairs, *rest: (asked.append(pairs.count()), within(docs, pairs, *rest))[1])
    got = {r["doc_id"]: (r["class_id"], r["same_as"]) for r in edits.classes(docs).collect()}
    assert {k: c for k, (c, _) in got.items()} == {k: want[k] for k in on}
    assert got[65] == (want[65], 5) and got[66] == (want[66], 64)
    assert sum(asked) < 300 < len(links)
    assert edits.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints(spark, corpus):
    rng = random.Random(2)
    texts = [" ".join(prose(rng, rng.randint(60, 400))) for _ in range(120)]
    for k in range(120):
        t = list(texts[k])
        for _ in range(rng.randint(1, max(1, len(t) // 100))):
            p = rng.randrange(len(t))
            how = rng.random()
            if how < 0.34:
                t[p] = rng.choice("abcdef")
            elif how < 0.67:
                del t[p]
            else:
                t.insert(p, "q")
        texts.append("".join(t))
    true = {(k, 120 + k) for k in range(120) if edits.distance(*(np.frombuffer(texts[j].encode("utf-32-le"), np.uint32) for j in (k, 120 + k)), int(0.01 * max(len(texts[k]), len(texts[120 + k])))) is not None}
    got = {(r["doc_a"], r["doc_b"]) for r in edits.near(table(spark, texts)).collect()}
    assert len(true) > 80
    assert got <= true and len(got) >= 0.9 * len(true)
    odd = {(r["doc_a"], r["doc_b"]): r["edits"] for r in edits.near(table(spark, corpus, CLASH), exact=True).collect()}
    assert odd[3, 60] == odd[3, 61] == odd[14, 62] == 0
    assert edits.near(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_recall_by_length_and_edits(spark):
    """Scattered edits, insertions alone, an inserted block, a header and changed words, from short texts to long ones."""
    rng = random.Random(21)

    def scattered(t, share, insert=False):
        t = list(t)
        for _ in range(int(share * len(t))):
            p, how = rng.randrange(len(t)), 1.0 if insert else rng.random()
            if how < 0.34:
                t[p] = rng.choice("abcdef")
            elif how < 0.67:
                del t[p]
            else:
                t.insert(p, "q")
        return "".join(t)

    def words(t, share):
        w = t.split(" ")
        for p in rng.sample(range(len(w)), int(share * len(w))):
            w[p] = prose(rng, 1)[0]
        return " ".join(w)

    ways = {
        "mixed": lambda t: scattered(t, 0.009), "inserted": lambda t: scattered(t, 0.009, True), "many": lambda t: scattered(t, 0.03), "words": lambda t: words(t, 0.1),
        "block": lambda t: t[: len(t) // 3] + " " + " ".join(prose(rng, len(t) // 60)) + t[len(t) // 3 :], "header": lambda t: " ".join(prose(rng, max(1, len(t) // 1000))) + " " + t,
    }
    texts, true = [], {}
    for size, pairs in ((150, 12), (2_000, 10), (20_000, 5), (100_000, 1)):
        for name, change in ways.items():
            for _ in range(pairs):
                t = " ".join(prose(rng, size // 5))[:size]
                true[len(texts), len(texts) + 1] = (size, name)
                texts += [t, change(t)]
    got = {(r["doc_a"], r["doc_b"]) for r in edits.near(table(spark, texts)).collect()}
    assert got <= set(true)
    for size in (150, 2_000, 20_000, 100_000):
        for name in ways:
            mine = [p for p, k in true.items() if k == (size, name)]
            assert len(got & set(mine)) >= 0.9 * len(mine), (size, name)


def test_word_hashes():
    texts = ["a bc  d\n", "", None, " xé ", "a" * 100]
    data, off = W.buffers(pa.array(texts))
    s, e, wo = W.spans(data, off)
    found = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    assert found == [w for t in texts for w in (t or "").split()] and wo.tolist() == [0, 3, 3, 3, 4, 5]
    h = W.hashes(data, s, e)
    assert len(set(h.tolist())) == len(set(found))
    g, go = W.ngrams(h, wo, 2)
    assert go.tolist() == [0, 2, 2, 2, 2, 2]


def test_scratch_tables(spark, corpus):
    with store.scope():
        t = store.cut(spark.range(5))
        assert t.count() == 5 and store.fresh(spark.range(1), "id", "x") == ["id_", "x"]
        path = t.inputFiles()[0]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    # a result outlives the scopes of others
    docs = table(spark, corpus)
    mine = jaccard.classes(docs)
    n = mine.count()
    with store.scope():
        jaccard.deduplicate(docs).count()
    assert mine.count() == n


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError):
        store.folder(Session)


@pytest.mark.parametrize("op", [automaton, rindex])
def test_repeats_in_large_groups(spark, monkeypatch, op):
    """A passage that a third of the documents hold is settled without gathering its group."""
    rng = random.Random(6)
    passage = prose(rng, 70)
    texts = [" ".join(prose(rng, rng.randint(20, 90)) + (passage[rng.randint(0, 12) :] if k % 3 == 0 else []) + prose(rng, 30)) for k in range(90)]
    monkeypatch.setattr(repeats, "GROUP", 5)
    got = {tuple(r) for r in op.repeated(table(spark, texts)).select("doc_id", "start_word", "n_words").collect()}
    assert got == spans_by_hand(texts, 50)


@pytest.mark.parametrize("op", [automaton, rindex])
def test_regions_of_a_text_full_of_passages(spark, monkeypatch, op):
    """A text made of passages of many others sends each of them its passage, not the whole text."""
    rng = random.Random(8)
    passages = [prose(rng, 70) for _ in range(40)]
    texts = [" ".join(prose(rng, 20) + p + prose(rng, 20)) for p in passages] + [" ".join(w for p in passages for w in p), " ".join(w for p in passages[::-1] for w in p)]
    monkeypatch.setattr(repeats, "SENT", 500, raising=False)
    docs = table(spark, texts)
    sent = repeats.regions(docs, 50).select(F.size("words").alias("n")).collect()
    assert sum(r["n"] for r in sent) < 10 * sum(len(t.split()) for t in texts)
    assert {tuple(r) for r in op.repeated(docs).select("doc_id", "start_word", "n_words").collect()} == spans_by_hand(texts, 50)


def test_backoff_blocks_are_narrow():
    """Blocks take no more bytes than their numbers need, and give back what went in."""
    n = 1000
    key = W.mix64(np.arange(n, dtype=np.uint64))
    few, base = np.arange(n) % 200, np.arange(n)
    for docs, counts, most in ((base + (1 << 60), few, 32), (base * (1 << 20) - (1 << 40), few, 34), (base - (1 << 62) * (base % 2 * 2 - 1), few * (1 << 20), 48)):
        batch = backoff.blocks(backoff.TRIGRAM, key, 7, key, key, key, docs, counts, counts, counts, few)
        assert sum(map(len, batch["rows"].to_pylist())) < most * n
        got = backoff.gathered(iter([batch]))[backoff.TRIGRAM]
        order = np.argsort(got[0])
        for mine, want in zip(got, (key, key, key, docs, counts, counts, counts, few)):
            assert (mine[order] == want[np.argsort(key)]).all()


def test_backoff_sends_no_counts_nobody_asks_for(spark, monkeypatch):
    """Bigrams of one document alone are counted where their trigrams are, and not sent on."""
    rng = np.random.default_rng(5)
    docs = table(spark, [" ".join(f"w{k}" for k in rng.integers(0, 40_000, 3000)) for _ in range(20)]).cache()
    sent, cut = [], store.cut

    def counting(df, outer=False):
        out = cut(df, outer)
        if "rows" in out.columns and "n" not in out.columns:
            sent.append(out.agg(F.sum(F.length("rows"))).first()[0] or 0)
        return out

    monkeypatch.setattr(store, "cut", counting)
    assert backoff.score(docs, 2).agg(F.sum("n_words")).first()[0] == 60_000
    assert sum(sent) < 25 * 60_000


def test_backoff_at_the_ends_of_documents(spark, monkeypatch):
    """Contexts are counted as words and bigrams without the last ones of documents, as in the SQL."""
    texts = ["a", "a", "a b", "b a", "a b", "a b a", "a b a b", "c a b", "b", "b b", "b b b", "c c", "x y", "x", "x y z", "z x y", "q", "a b c d e", "b c d e", "c d e f", "d e"]
    docs = table(spark, texts).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = {r[0]: r[1:] for r in con.sql(backoff.oracle()).fetchall()}
    for frequent in (backoff.FREQUENT, 2, 3):
        monkeypatch.setattr(backoff, "FREQUENT", frequent)
        for rounds in (1, 3):
            got = {r["doc_id"]: r for r in backoff.score(docs, rounds).collect()}
            assert set(got) == set(want)
            for i, (n, less, score) in want.items():
                assert (got[i]["n_words"], got[i]["backed_off"]) == (n, less)
                assert abs(got[i]["log_score"] / n - score) < 2e-6
