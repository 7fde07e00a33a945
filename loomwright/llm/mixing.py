"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic; the sums are raked in turn to
the three target marginals until they fit, and each document is kept with the
probability that its cell's raked weight asks for.

Cases: nulls in source or language are a value of their own (``?``); documents
without words have weight 0 and are kept with the probability of their cell; a
null id is drawn as id -1; rows of the same id are drawn alike; an empty table
gives an empty sample.  Other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

ROUNDS = 40
DAMPING = 0.8
SHARE = 0.85
#: Topics by the initials that lead most of a text's words.
INITIALS = ("a-h", "i-p", "q-z")
CELL_LIMIT = 1_000_000


def topic_of(text: str = "text") -> Column:
    """0-2: the group of initials that begins most words after a blank (ties to the lower); 3 where none does."""
    n = [F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f" [{g}]")) for g in INITIALS]
    return F.when(n[0] + n[1] + n[2] == 0, 3).when((n[0] >= n[1]) & (n[0] >= n[2]), 0).when(n[1] >= n[2], 1).otherwise(2)


def tokens_of(text: str = "text") -> Column:
    """Words of a text: runs of anything but ASCII blanks."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\t\n\f\r ]+")).cast("long")


def uniform(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id), F.lit(-1)).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(cells: np.ndarray, n: np.ndarray) -> list[dict]:
    """Default marginals: shares of tokens, damped by the power ``DAMPING`` to lift what is scarce."""
    out = []
    for k in range(3):
        sums: dict = {}
        for key, v in zip(cells[k], n):
            sums[key] = sums.get(key, 0.0) + float(v)
        damped = {key: v**DAMPING if v > 0 else 0.0 for key, v in sums.items()}
        total = sum(damped.values()) or 1.0
        out.append({key: v / total for key, v in damped.items()})
    return out


def rake(cells: list[list], n: np.ndarray, goal: list[dict], rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the cells that fit the marginals ``goal`` in turn, starting from those of ``n``."""
    w = n.astype(float) / max(n.sum(), 1)
    for _ in range(rounds):
        for k in range(3):
            keys, at = np.unique(np.array(cells[k], object).astype(str), return_inverse=True)
            now = np.bincount(at, w)
            want = np.array([{str(a): b for a, b in goal[k].items()}.get(x, 0.0) for x in keys])
            w = w * np.where(now > 0, want / np.where(now > 0, now, 1), 0)[at]
    return w


def probabilities(n: np.ndarray, w: np.ndarray, share: float) -> np.ndarray:
    """min(1, s * w / n) with s such that the kept tokens are ``share`` of all: cells that hit 1 pass their rest on."""
    ok = (n > 0) & (w > 0)
    ratio = np.where(ok, w / np.where(n > 0, n, 1), 0)
    order = np.argsort(-ratio, kind="stable")
    full = np.concatenate([[0], np.cumsum(n[order])])[:-1]
    left = np.concatenate([np.cumsum((w * ok)[order][::-1])[::-1], [0]])[:-1]
    budget = share * n.sum()
    s = (budget - full) / np.where(left > 0, left, 1)
    fits = s * ratio[order] <= 1 + 1e-12
    if not fits.any() or not ok.any():
        return np.ones(len(n))
    return np.where(n > 0, np.minimum(1, s[np.argmax(fits)] * ratio), 1.0)


def weigh(docs: DataFrame, share: float = SHARE, topic: Column | None = None, goal: list[dict] | None = None) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_topic`` and ``mix_p``, the probability of being kept.

    Cells are metadata (sources x languages x topics); their number is checked
    before they come to the driver.  Columns of those names are replaced.
    """
    docs = docs.drop("mix_tokens", "mix_topic", "mix_p")
    keyed = docs.withColumns({"mix_tokens": tokens_of(), "mix_topic": topic_of() if topic is None else topic})
    src, lang = F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))
    sums = keyed.select(src.alias("s"), lang.alias("l"), F.col("mix_topic").alias("t"), "mix_tokens").groupBy("s", "l", "t").agg(F.sum("mix_tokens").alias("n")).orderBy("s", "l", "t").limit(CELL_LIMIT + 1).toArrow().to_pydict()
    if len(sums["n"]) > CELL_LIMIT:
        raise ValueError("too many cells of source, language and topic to rake on the driver")
    cells = [sums["s"], sums["l"], sums["t"]]
    n = np.array(sums["n"], float)
    if not len(n):
        return keyed.withColumn("mix_p", F.lit(1.0))
    w = rake(cells, n, goal or targets(cells, n))
    p = probabilities(n, w, share)
    a, b, c, q = store.fresh(keyed, "cell_s", "cell_l", "cell_t", "cell_p")
    table = docs.sparkSession.createDataFrame([(s, l, t, float(x)) for s, l, t, x in zip(*cells, p)], f"{a} string, {b} string, {c} int, {q} double")
    found = keyed.join(F.broadcast(table), (src == table[a]) & (lang == table[b]) & (F.col("mix_topic") == table[c]), "left")  # at most CELL_LIMIT rows
    return found.withColumn("mix_p", F.col(q)).drop(a, b, c, q)


def sample(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents drawn, all columns unchanged; the same ids are drawn on every run."""
    mine = ("mix_tokens", "mix_topic", "mix_p")
    renamed = {c: n for c, n in zip(mine, store.fresh(docs, *mine)) if c != n}
    rows = weigh(docs.withColumnsRenamed(renamed), share).where(uniform() < F.col("mix_p")).drop(*mine)
    return rows.withColumnsRenamed({n: c for c, n in renamed.items()})


def oracle(documents: str = "documents", rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL."""
    n = [f"len(regexp_extract_all(coalesce(text, ''), ' [{g}]'))" for g in INITIALS]
    step = "w"
    inner = "SELECT s, l, t, n, ws, wl, wt, it, w FROM ipf WHERE it < {0}".format(rounds)
    for key, want in (("s", "ws"), ("l", "wl"), ("t", "wt")):
        inner = f"SELECT s, l, t, n, ws, wl, wt, it, CASE WHEN sum({step}) OVER (PARTITION BY {key}) > 0 THEN w * {want} / sum(w) OVER (PARTITION BY {key}) ELSE 0 END AS w FROM ({inner})"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, coalesce(source, '?') s, coalesce(lang, '?') l,
    len(regexp_extract_all(coalesce(text, ''), '[^\\t\\n\\f\\r ]+')) k,
    CASE WHEN {n[0]} + {n[1]} + {n[2]} = 0 THEN 3 WHEN {n[0]} >= {n[1]} AND {n[0]} >= {n[2]} THEN 0 WHEN {n[1]} >= {n[2]} THEN 1 ELSE 2 END t
  FROM {documents}),
cells AS (SELECT s, l, t, sum(k)::DOUBLE n FROM keyed GROUP BY ALL),
ms AS (SELECT s, pow(sum(n), {DAMPING}) / sum(pow(sum(n), {DAMPING})) OVER () ws FROM cells GROUP BY s),
ml AS (SELECT l, pow(sum(n), {DAMPING}) / sum(pow(sum(n), {DAMPING})) OVER () wl FROM cells GROUP BY l),
mt AS (SELECT t, pow(sum(n), {DAMPING}) / sum(pow(sum(n), {DAMPING})) OVER () wt FROM cells GROUP BY t),
ipf AS (
  SELECT s, l, t, n, ws, wl, wt, 0 AS it, n / sum(n) OVER () AS w FROM cells JOIN ms USING (s) JOIN ml USING (l) JOIN mt USING (t)
  UNION ALL
  SELECT s, l, t, n, ws, wl, wt, it + 1, w FROM ({inner})),
done AS (SELECT s, l, t, n, w, CASE WHEN n > 0 THEN w / n ELSE 0 END r FROM ipf WHERE it = {rounds}),
cum AS (SELECT *, ({SHARE} * sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY r DESC, s, l, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(w) OVER (ORDER BY r DESC, s, l, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) sc FROM done),
scale AS (SELECT arg_max(sc, r) FILTER (sc * r <= 1 + 1e-12) sc FROM cum),
prob AS (SELECT s, l, t, CASE WHEN n > 0 THEN least(1.0, scale.sc * r) ELSE 1.0 END p FROM done, scale)
SELECT doc_id, k AS tokens, t AS topic, round(p, 9) AS p
FROM keyed JOIN prob USING (s, l, t)
WHERE ('0x' || substr(md5(CAST(coalesce(doc_id, -1) AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0 < p"""
