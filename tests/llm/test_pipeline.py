"""The pipeline's stages on a small corpus, each against brute force on its own input."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from loomwright.llm import mixing

from .test_operators import SCHEMA, _components, excerpts, jaccard_by_hand, prose, spans_by_hand, table


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [" ".join(prose(rng, rng.randint(60, 200))) + "." for _ in range(200)]
    texts += [" ".join(w.upper() + "!!" for w in prose(rng, 80)) for _ in range(60)]
    texts += [" ".join(prose(rng, 40) + ["vile", "oaf"] + prose(rng, 40)) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [" ".join(prose(rng, 90) + passage + prose(rng, 30)) for _ in range(12)] + texts[:12]
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["en", "de"][i % 2], f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 260), int(260 <= i < 320)) for i in range(320)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, out[-1], str(root)).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return str(root), out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, stages):
    root, tables = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "passages", "mixing", "encode"]
    for df in tables[1:-1]:
        assert df.columns == tables[0].columns
    a, b, c, d, e, f = map(rows, tables)
    clean = [i for i in a if not 200 <= i < 320]
    assert len([i for i in clean if i in b]) >= 0.97 * len(clean)
    assert len([i for i in b if 200 <= i < 320]) <= 6
    order = sorted(b)
    true = jaccard_by_hand([b[i]["text"] for i in order])
    gone = {order[x] for g in _components(true) for x in g if x != min(g)}
    assert set(c) == set(b) - gone
    order = sorted(c)
    spans = spans_by_hand([c[i]["text"] for i in order], 50)
    assert {i for i in d if d[i]["text"] != c[i]["text"]} == {order[i] for i, _, _ in spans}
    assert set(e) < set(d) and len(e) > 0.7 * len(d)
    assert set(f) == set(e) and all(r["round_trip"] for r in f.values())


def test_run_is_the_stages(spark, stages):
    root, tables = stages
    got = rows(corpus_pipeline.run(spark, root))
    want = rows(tables[-1])
    assert {i: r["token_ids"] for i, r in got.items()} == {i: r["token_ids"] for i, r in want.items()}
    assert mixing.SHARE < 1


def test_no_near_copy_is_left(spark):
    """Near copies alike by lines that many others have, too."""
    texts = excerpts(random.Random(13))
    gone = {b for _, b in jaccard_by_hand(texts)}
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, texts), "")
    assert len(gone) == 6 and set(rows(kept)) == set(range(len(texts))) - gone
