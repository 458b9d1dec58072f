"""Approximate nearest neighbours along shifted Hilbert curves.

Every vector is projected and shifted anew for each of several curves and ordered by its place along the curve; Spark deals the
orderings out by range and counts the places. A query reads a window of places around its own on every curve; the windows merge, and
candidates are ranked by the exact distance. The width of the window is measured, not guessed: for a bounded sample of
queries the true neighbours are found by brute force over all rows, and the window must reach ``target`` of them on some curve.
Where neighbours say little about places (directions all alike), windows grow until they hold nearly all rows; the work then
is that of comparing all queries with all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, positions
from rfsense.llm.vectors import dealt, groups, matrix, usable, wide_hash
from rfsense.session import materialise, ship

CURVES, DIMS, BITS = 8, 8, 7
CHUNK = 2048
"""Places of a curve that are read together; windows are widened to whole chunks."""
FITTED = 2048
"""Vectors, about, whose mean and spread scale the curves."""
SAMPLE = 128
"""Queries, about, whose true neighbours set the window."""
TARGET = 0.96
"""Share of the sample's neighbours that the windows hold."""


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of integers below ``2**bits`` (Skilling's transform, all rows at once)."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def places(vectors: np.ndarray, curve: int, centre: np.ndarray, spread: float) -> np.ndarray:
    """Keys of one curve: a random projection and a random shift of its own."""
    rng = np.random.default_rng(1000 + curve)
    dims = min(DIMS, vectors.shape[1])
    turn = rng.standard_normal((vectors.shape[1], dims)) / np.sqrt(vectors.shape[1])
    unit = (vectors - centre) @ turn / (spread or 1.0)  # about a standard normal in each dimension
    shift = rng.uniform(0, 0.5, dims)
    grid = np.floor((np.clip((unit + 4) / 8, 0, 1) * 0.5 + shift) * (1 << BITS))
    return hilbert(np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64), BITS)


_TOP = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, reps: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` nearest rows of each query, by exact distance and then id."""
    out: list[list[np.ndarray]] = [[], [], []]
    square = (rows**2).sum(axis=1)
    step = max(1, (1 << 21) // max(1, len(rows)))
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        own = (q**2).sum(axis=1)
        rough = own[:, None] + square[None, :] - 2 * q @ rows.T
        slack = 1e-9 * (own + square.max(initial=0.0))
        kth = np.partition(rough, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        i, j = np.nonzero(rough <= (kth + slack)[:, None])
        d = np.sqrt(((q[i] - rows[j]) ** 2).sum(axis=1))
        order = np.lexsort((reps[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        for column, value in zip(out, (ids[at:at + step][i[keep]], reps[j[keep]], d[keep]), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, _TOP, strict=True)], schema=_TOP)


def _against(queries: np.ndarray, ids: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield nearest(queries, ids, matrix(batch.column("v")), batch.column("rep").to_numpy(), k)

    return arrow_map(run, _TOP)


def _windows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        for _, part, new in groups(batches, ["curve", "chunk"]):
            if new:
                rows = []
            asks = part.column("asks").to_numpy(zero_copy_only=False)
            n = int((~asks).sum())  # rows come before queries
            if n:
                rows.append(part.slice(0, n))
            if n < len(asks) and rows:
                held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                rows = [held]
                q = part.slice(n)
                yield nearest(matrix(q.column("v")), q.column("rep").to_numpy(), matrix(held.column("v")), held.column("rep").to_numpy(), k)

    return arrow_map(run, _TOP)


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", *by))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, asked: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``asked`` marks, its ``k`` nearest other rows, ties to the smaller id.

    ``score`` is the Euclidean distance in double precision. Null, empty or zero vectors, those with null or non-finite components,
    those of another length than most, and rows without an id take no part. Equal vectors are one place on a curve and come back one by
    one. Of rows that repeat an id, any one stands for it if they are equal; else each is a candidate. With fewer rows all
    are returned; without rows, or queries, nothing is.
    """
    spark = vectors.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = vectors.withColumn("_ask", asked).where(usable(vector)).select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce("_ask", F.lit(False)).alias("asks")).where("vec_id is not null")
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return empty
    good = good.where(F.size("v") == usual["d"]).withColumn("key", wide_hash("v"))
    # The k + 1 smallest ids of equal vectors; Spark limits them before the shuffle.
    few = good.withColumn("_r", F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    classes = few.groupBy("key").agg(F.min("vec_id").alias("rep"), F.any_value("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = materialise(classes, "classes")
    queries = materialise(good.where("asks").select("vec_id", "key").distinct().join(classes.select("key", "rep"), "key"), "queries")
    asking = queries.select("rep").distinct().join(classes, "rep").select("rep", "v")

    def sampled(rows: DataFrame, size: int, most: int) -> DataFrame:
        """About ``size`` rows by a hash of the id, in any case no more than ``most``."""
        every = max(1, rows.count() // size)
        return rows.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(every)) == 0).limit(most)

    n = classes.count()
    fitted = np.stack(sampled(classes.select("rep", "v"), FITTED, 4 * FITTED).toPandas()["v"].to_list()).astype(float)
    centre = fitted.mean(axis=0)
    spread = float(np.sqrt(((fitted - centre) ** 2).sum(axis=1).mean() / fitted.shape[1]))

    schema = pa.schema([("curve", pa.int32()), ("place", pa.int64()), ("rep", pa.int64()), ("v", pa.list_(pa.float64()))])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column("v"))
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c), pa.int32()), pa.array(places(m, c, centre, spread)), batch.column("rep"), batch.column("v")], schema=schema)

    along = classes.select("rep", "v").mapInArrow(arrow_map(order, schema), "curve int, place long, rep long, v array<double>")
    along = materialise(positions(along, ["curve", "place", "rep"]).withColumn("pos", F.col("pos") - F.col("curve") * F.lit(n)).drop("place"), "along")

    trial = sampled(asking, SAMPLE, 4 * SAMPLE).toPandas()
    if not len(trial):
        return empty
    ids, tried = trial["rep"].to_numpy(), np.stack(trial["v"].to_list())
    true = _best(classes.select("rep", "v").mapInArrow(_against(tried, ids, k + 1), "query long, rep long, score double"), k + 1, "rep").where("query <> rep")
    at = along.select("curve", "rep", "pos")
    gaps = true.join(at, "rep").join(at.select("curve", F.col("rep").alias("query"), F.col("pos").alias("own")), ["curve", "query"])
    # SAMPLE x k numbers
    gap = [r["gap"] for r in gaps.groupBy("query", "rep").agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("gap")).collect()]
    width = int(np.quantile(gap, target, method="higher")) if gap else 0

    last = (n - 1) // chunk
    rows = along.select("curve", F.floor(F.col("pos") / chunk).alias("chunk"), F.lit(False).alias("asks"), "rep", "v")
    first, final = F.greatest(F.floor((F.col("pos") - width) / chunk), F.lit(0)), F.least(F.floor((F.col("pos") + width) / chunk), F.lit(last))
    asks = along.join(asking.select("rep"), "rep", "left_semi").withColumn("chunk", F.explode(F.sequence(first, final))).select("curve", "chunk", F.lit(True).alias("asks"), "rep", "v")
    found = dealt(rows.unionByName(asks), ["curve", "chunk"], "asks").mapInArrow(_windows(k + 1), "query long, rep long, score double")
    best = _best(found.groupBy("query", "rep").agg(F.min("score").alias("score")), k + 1, "rep").drop("rank")
    single = best.join(classes.select("rep", "ids"), "rep").select(F.col("query"), "score", F.explode("ids").alias("vec_id"))
    asked_for = queries.select(F.col("rep").alias("query"), F.col("vec_id").alias("query_id")).join(single, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return asked_for.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
