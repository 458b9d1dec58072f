"""Hard negatives by the R-tree against all pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfsense.llm import hardneg
from rfsense.llm.queries import QUERIES
from tests.conftest import SF

DDL = "vec_id long, embedding array<float>, label int, page int, cid int, key int, `a.b` int"
NAN = float("nan")
ODD = [(900, None, 1), (901, [1.0] * 6, None), (902, [NAN] * 6, 1), (903, [1.0] * 5, 1), (None, [1.0] * 6, 1), (904, [0.0] * 6, 0), (700, [0.5] * 6, 1), (700, [0.5] * 6, 1),
       (705, [0.25] * 6, 1), (950, [], 1), (950, [1e30] * 6, 1), (960, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1000, [1000.0] * 6, 1), (1001, [900.0] * 6, 2), (1010, [-1.0] * 6, 1)]


def by_hand(rows, every, positives=5, negatives=3):
    seen = {(i, label, tuple(float(np.float32(x)) for x in v)) for i, v, label in rows
            if None not in (i, label) and v and all(x is not None and np.isfinite(x) for x in v)}
    usual = max(c := Counter(len(v) for _, _, v in seen), key=lambda d: (c[d], d), default=0)
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in seen if len(v) == usual]
    whole = [r for r in whole if sum(x * x for x in r[2]) < 2**62]
    out = []
    for a in whole:
        if a[0] % every == 0:
            scored = [(sum(x * y for x, y in zip(a[2], r[2], strict=True)), r) for r in whole if r is not a]
            for p, r in sorted((s for s in scored if s[1][1] == a[1]), key=lambda s: (-s[0], s[1][0]))[:positives]:
                fit = sorted((s for s in scored if s[1][1] != a[1] and 50 * p <= 100 * s[0] <= 95 * p), key=lambda s: (-s[0], s[1][0]))
                out += [(a[0], r[0], k + 1, s[1][0], p, s[0]) for k, s in enumerate(fit[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def clustered():
    """Vectors around centres, and one vector that many rows of two labels share."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 6))
    rows = [(i, [float(x) for x in centres[rng.integers(20)] + rng.standard_normal(6) * 0.4], int(rng.integers(3))) for i in range(500)]
    return rows + [(700 + i, [0.5] * 6, 1) for i in range(60)] + [(800 + i, [0.5] * 6, 2) for i in range(60)] + ODD


@pytest.mark.parametrize("page", [2048, 50])
def test_all_pairs(spark, clustered, page):
    got = hardneg.mine(frame(spark, clustered), F.col("vec_id") % 10 == 0, page=page).collect()
    assert sorted(map(tuple, got)) == by_hand(clustered, 10) and len(got) > 500


def test_nothing(spark):
    assert hardneg.mine(frame(spark, ODD).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hardneg.mine(frame(spark, ODD), F.lit(False)).count() == 0
    assert sorted(map(tuple, hardneg.mine(frame(spark, ODD), F.col("vec_id") % 10 == 0).collect())) == by_hand(ODD, 10)


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label if r.vec_id % 7 or r.label is None else (r.label + 1) % 10) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, SF).collect())) == by_hand(rows, 50)


def test_tree():
    """Every row lies in one leaf, boxes hold their rows, bounds hold all scores; the queue visits few leaves of clustered rows."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (30, 4))
    rows = centres[rng.integers(30, size=2000)] + rng.integers(-5, 6, (2000, 4))
    page = hardneg.Page(rows, rng.integers(0, 2, 2000), np.arange(2000), [[i] for i in range(2000)])
    assert sorted(page.number.tolist()) == list(range(2000))
    queries = rows[:50]
    least, most = hardneg.bounds(queries, page.leaf_low, page.leaf_high)
    for j, (a, b) in enumerate(page.leaves):
        got = hardneg.scores(queries, page.rows[a:b])
        assert (got >= least[:, j:j + 1]).all() and (got <= most[:, j:j + 1]).all() and len(set(page.label[a:b])) == 1
    visited, plain = [], hardneg.scores
    try:
        hardneg.scores = lambda q, r: visited.append(len(q) * len(r)) or plain(q, r)
        none, all_ = np.full((50, 1), hardneg.LEAST), np.full((50, 1), -hardneg.LEAST)
        for i in range(50):
            page.search(queries[i:i + 1], np.zeros(1, int), none[:1], all_[:1], none[:1], 3, True)
    finally:
        hardneg.scores = plain
    assert sum(visited) < 0.35 * 50 * 2000
