"""Helpers that several operators share: text columns, text slices, global positions, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rfsense.session import materialise, ship

SLICE_BYTES = 2 << 20
"""Text that a Python worker works on at a time; one longer document makes a slice of its own."""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the named columns; all others are left out."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on for other stages, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no piece of several rows holds more than ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between the six ASCII white-space characters.

    Returns the code of each word, the distinct words by code, and for each text the number of words.
    ``lower`` turns A-Z, and nothing else, to small letters.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat, ends = split.flatten(), np.asarray(split.offsets)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate(([0], np.cumsum(full)))
    coded = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.diff(kept[ends])


def gather(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[c] : starts[c] + lengths[c]]`` of all codes one after another, and the length of each."""
    n = lengths[codes]
    before = np.cumsum(n) - n
    return flat[np.repeat(starts[codes] - before, n) + np.arange(int(n.sum()))], n


def positions(df: DataFrame, order: list[str], weight: str | None = None, out: str = "pos") -> DataFrame:
    """Adds the number of rows before each row in ``order``, or the sum of ``weight`` over them.

    Rows are dealt out by ranges of ``order`` and written once, so that the partition of a row is fixed; only
    one row per partition is summed in a single task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    )
    placed = materialise(placed, "positions")
    value = F.lit(1) if weight is None else F.col(weight)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select("_part", F.coalesce(F.sum("_total").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    if weight is None:
        inside = F.col("_row").bitwiseAND((1 << 33) - 1)
    else:
        inside = F.coalesce(F.sum(weight).over(
            Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per partition of the shuffle: bounded by the number of partitions, not by the data.
    return placed.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(
        out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_row", "_inside", "_before")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node hands its least neighbour to its other neighbours."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the least node of the component of every node that has an edge.

    Alternating large and small stars; each round is written to the shared folder, until nothing changes. A node
    with very many neighbours is reduced by a partial ``min``, and its join is one that Spark can split.
    """
    now = materialise(edges.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a")).where("a <> b").distinct(), "edges")
    while True:
        after = materialise(_stars(_stars(now, True), False), "edges")
        same = F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count(F.lit(1))
        if now.agg(*same).first() == after.agg(*same).first():
            break
        now = after
    members = after.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of pairs that hold together what all pairs hold together."""
    keep, parent = [], {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := find(x)) != (y := find(y)):
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def arrow_map(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: pa.Schema):
    """``fn`` for mapInArrow; an empty partition gives no batch, and every batch has exactly ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield out.cast(schema) if out.schema != schema else out

    return run
