"""Vector operators against all pairs."""

import contextlib
import os
import tempfile
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfsense.llm import common, neardup_vectors, neighbours
from rfsense.llm.queries import QUERIES
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")
DDL = "vec_id long, embedding array<float>, label int, rep long, kind string, v int"
ODD = [
    (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None), (6, None, 1),
    (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 0.0], 1), (10, [1.0, NAN, 0.0], 1), (11, [1.0, INF, 0.0], 1), (12, [1.0, 0.0], 1),
    (None, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0, 0.0], 1), (14, [0.95, 0.3, 0.0], 1), (15, [0.75, 0.66, 0.0], 1), (16, [1.0, 0.0], 1),
]


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def linked_by_hand(rows, threshold):
    """(vec_id, n_links, component) with all pairs; rows of one id share a component."""
    vectors = [np.array(v, np.float32).astype(float) if good(v) and k is not None else None for _, v, k in rows]
    links, root = [0] * len(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b / np.sqrt(a @ a * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                if rows[i][0] is not None and rows[j][0] is not None:
                    x, y = find(rows[i][0]), find(rows[j][0])
                    root[max(x, y)] = min(x, y)
    return [(r[0], n, None if r[0] is None else find(r[0]), r[0] is not None and find(r[0]) == r[0]) for r, n in zip(rows, links, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 5) for r in rows], DDL).repartition(3)


def clustered(n, dims, seed):
    """Vectors around centres, at distances about the threshold; some twice."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dims)) * rng.choice([0.02, 0.18, 0.26], (n, 1))
    x[n - 10:] = x[:10]
    return [(int(i), [float(c) for c in v], int(i) % 2) for i, v in enumerate(x)]


@pytest.mark.parametrize("dims, tile", [(3, 2048), (16, 2048), (64, 2048), (64, 8), (21, 16)])
def test_links(spark, dims, tile):
    rows = clustered(240, dims, dims)
    got = neardup_vectors.near_duplicates(frame(spark, rows), 0.93, tile).collect()
    assert sorted(map(tuple, got)) == sorted(linked_by_hand(rows, 0.93))
    assert sum(g.n_links for g in got) > 50


def test_odd_vectors(spark):
    got = neardup_vectors.near_duplicates(frame(spark, ODD), 0.93).collect()
    assert sorted(map(tuple, got), key=str) == sorted(linked_by_hand(ODD, 0.93), key=str)
    assert neardup_vectors.near_duplicates(frame(spark, ODD).limit(0), 0.93).count() == 0


@pytest.mark.parametrize("ddl, tile, slab", [("float", 8, 16), ("float", 32, 96), ("double", 8, 1000)])
def test_links_across_slabs(spark, ddl, tile, slab):
    """Labels of many slabs, of one tile and of one row; vectors that many rows hold, with and without ids."""
    rows = [(i, v, i % 2 if i < 200 else i // 4) for i, v, _ in clustered(240, 16, 5)]
    rows = [(i, [float(np.float32(c)) for c in v], k) for i, v, k in rows]
    rows += [(500 + i, rows[0][1], 0) for i in range(60)] + [(None, rows[1][1], 1)] * 40 + [(900, rows[2][1], 0)] * 5
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{ddl}>, label int").repartition(3)
    got = neardup_vectors.near_duplicates(df, 0.93, tile, slab=slab).collect()
    assert sorted(map(tuple, got), key=str) == sorted(linked_by_hand(rows, 0.93), key=str)
    assert sum(g.n_links for g in got) > 5000


def test_links_on_little_disk(spark, monkeypatch, tmp_path):
    """What is shuffled and kept grows with the table, not with its pairs or blocks."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 64)).astype(np.float32)
    x[6_000:6_100] = x[:100] + np.float32(0.001)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    tops = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), str(tmp_path)]
    seen, done = [], threading.Event()

    def watch():
        while not done.wait(0.05):
            held = 0
            for folder, _, names in (x for top in tops for x in os.walk(top)):
                for name in names:
                    with contextlib.suppress(OSError):  # files go meanwhile
                        held += os.stat(os.path.join(folder, name)).st_size
            seen.append(held)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        got = neardup_vectors.near_duplicates(spark.read.parquet(str(tmp_path / "in")), 0.93).collect()
    finally:
        done.set()
        thread.join()
    assert sorted(g.vec_id for g in got if g.n_links) == [*range(100), *range(6_000, 6_100)]
    assert max(seen) - seen[0] < 4 * sum(f.stat().st_size for f in (tmp_path / "in").rglob("*.parquet"))


@pytest.mark.parametrize("n", [3, 40])
def test_stars(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 60, n), rng.integers(0, 60, n)
    chain = np.arange(100, 400)
    a, b = np.concatenate([a, chain, [7]]), np.concatenate([b, chain + 1, [7]])
    root = {x: x for x in [*a, *b]}
    for _ in range(400):
        for x, y in zip(a, b, strict=True):
            root[x] = root[y] = min(root[x], root[y])
    assert dict(zip(*neardup_vectors.stars(a, b), strict=True)) == {x: r for x, r in root.items() if x != r}


def test_links_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op1_near_duplicate_vectors"](spark, SF).collect())) == sorted(linked_by_hand(rows, 0.93))


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(200)] + [(300 + int(a), 300 + int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(1000, 1000 + i) for i in range(1, 300)]
    root = {x: x for e in chain for x in e}
    for _ in range(400):
        for a, b in chain:
            root[a] = root[b] = min(root[a], root[b])
    got = common.components(spark.createDataFrame(chain, "a long, b long")).collect()
    own = {x for a, b in chain if a != b for x in (a, b)}
    assert {r.node: r.root for r in got} == {x: root[x] for x in own} and len(got) == len(own)


def nearest_by_hand(rows, k):
    seen = {}
    for i, v, _ in rows:
        if good(v) and i is not None and len(v) == 3:
            seen[i] = np.array(v, np.float32).astype(float)
    out = []
    for q in seen:
        if q % 2 == 0:
            best = sorted((float(np.sqrt(((seen[q] - x) ** 2).sum())), i) for i, x in seen.items() if i != q)[:k]
            out += [(q, n + 1, i, round(d, 12)) for n, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k, chunk", [(3, 2048), (50, 2)])
def test_odd_neighbours(spark, k, chunk):
    got = neighbours.search(frame(spark, ODD), F.col("vec_id") % 2 == 0, k, chunk=chunk, target=1.0).collect()
    assert sorted((g.query_id, g.rank, g.vec_id, round(g.score, 12)) for g in got) == nearest_by_hand(ODD, k)
    assert neighbours.search(frame(spark, ODD).limit(0), F.col("vec_id") % 2 == 0, k).count() == 0
    assert neighbours.search(frame(spark, ODD), F.col("vec_id") < 0, k).count() == 0


def test_recall(spark):
    """Clustered vectors, small chunks: few rows are read, and 0.9 of the neighbours are found."""
    rows = clustered(3000, 24, 9)
    got = neighbours.search(frame(spark, rows), F.col("vec_id") % 50 == 0, 10, chunk=32).collect()
    x, hits = np.array([np.array(r[1], np.float32) for r in rows], float), 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(3000), d))[:10]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert np.allclose([s for *_, s in own], d[[i for _, i, _ in own]], rtol=1e-12, atol=0)
        hits += len(set(true) & {i for _, i, _ in own})
    assert hits >= 0.9 * 600


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got, hits = QUERIES["op10_neighbours"](spark, SF).toPandas(), 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got["vec_id"][got["query_id"] == ids[q]]))
    assert hits >= 0.9 * len(got) and got.groupby("query_id").size().eq(10).all()


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = neighbours.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
