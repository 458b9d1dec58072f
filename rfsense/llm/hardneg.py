"""Hard negatives by an R-tree over vectors, packed by sort-tile-recursion.

A row's score for an anchor is the integer inner product of their vectors, each component ``floor(scale * x)``. An anchor's positives are the rows of
its label that score highest; for each positive the negatives are the highest-scoring rows of other labels whose score lies in a window below the
positive's.

Equal vectors of one label are one class with its least ids. Classes are tiled along the coordinates of greatest spread (cuts fitted on a bounded sample), put in
one order by Spark and cut into pages of at most ``PAGE``; each page is a subtree whose leaves hold one label. A box bounds an inner product by
the interval that each of its coordinates allows. Anchors first go through the boxes of all pages, in blocks; each visits its most
promising page, and then every other page whose box reaches into one of its windows and is not strictly below the k-th score it has by then. Inside a page
a queue takes the box of highest bound first, for a block of anchors at a time, and prunes in the same way. The result is exact. Vectors whose directions are all
alike have boxes that exclude little: nearly all pages are visited then, and the work is that of comparing all anchors with all rows, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, positions
from rfsense.llm.vectors import dealt, groups, matrix, wide_hash
from rfsense.session import materialise, ship

PAGE = 2048
"""Classes of a page."""
LEAF, FAN = 64, 8
"""Classes of a leaf, leaves of an inner box."""
SAMPLE, MOST_SAMPLE = 8192, 32768
"""Classes, about and at most, on which the cuts of the tiles are fitted."""
TILES = 512
"""The most tiles; pages are cut along a further coordinate within them."""
BOXES = 512
"""Boxes of a block of the directory."""
TOGETHER = 128
"""Anchors that go through a page side by side."""
LEAST = -(2**63 - 1)

Cuts = tuple  # (coordinate, cuts, one Cuts for each slab or None)


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers."""
    return np.floor(scale * vectors).astype(np.int64)


def tiles(sample: np.ndarray, coordinates: list[int], each: int, depth: int) -> Cuts | None:
    """Cuts into ``each`` slabs of equal numbers along each coordinate in turn."""
    if not depth or len(sample) < each:
        return None
    c = coordinates[0]
    order = np.sort(sample[:, c])
    cuts = np.unique(order[np.arange(1, each) * len(order) // each])
    slab = np.searchsorted(cuts, sample[:, c], side="right")
    return c, cuts, [tiles(sample[slab == s], coordinates[1:], each, depth - 1) for s in range(len(cuts) + 1)]


def tile_of(rows: np.ndarray, cuts: Cuts | None, each: int, depth: int) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    if cuts is None or not len(rows):
        return out
    c, values, below = cuts
    slab = np.searchsorted(values, rows[:, c], side="right")
    for s in np.unique(slab):
        own = slab == s
        out[own] = s * each ** (depth - 1) + tile_of(rows[own], below[s], each, depth - 1)
    return out


def safe(*parts: np.ndarray) -> bool:
    """Inner products are exact in doubles."""
    most = max((int(np.abs(p).max(initial=0)) for p in parts), default=0)
    return most * most * max(1, parts[0].shape[1]) < 1 << 52


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if safe(queries, rows):
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest inner product of each query with anything in each box, from the interval of each coordinate."""
    q, low_f, high_f = queries.astype(float), low.astype(float), high.astype(float)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    least, most = plus @ low_f.T + minus @ high_f.T, plus @ high_f.T + minus @ low_f.T
    if not safe(queries, low, high):  # rounded: a little wider
        room = 1e-12 * q.shape[1] * (np.abs(q) @ np.maximum(np.abs(low_f), np.abs(high_f)).T) + 1
        least, most = least - room, most + room
    return least, most


def reaching(least: np.ndarray, most: np.ndarray, fits: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Which boxes (columns) may hold a row for a query (rows): the label fits, and the interval meets a window and is not strictly below its k-th score."""
    hit = np.zeros(least.shape, bool)
    for w in range(low.shape[1]):
        floor = np.maximum(low[:, w], kth[:, w])[:, None]
        hit |= (low[:, w] <= high[:, w])[:, None] & (most >= floor) & (least <= high[:, w][:, None])
    return hit & fits


class Page:
    """The subtree of a page: leaves of one label each, and boxes of some leaves."""

    def __init__(self, rows: np.ndarray, label: np.ndarray, number: np.ndarray, ids: list[list[int]]):
        spread = np.argsort(-rows.astype(float).var(axis=0), kind="stable") if len(rows) else []
        parts = [self._packed(rows, np.flatnonzero(label == x), list(spread)) for x in np.unique(label)]
        order = np.concatenate([leaf for part in parts for leaf in part])
        self.rows, self.label, self.number, self.ids = rows[order], label[order], number[order], [ids[i] for i in order]
        self.least_id = np.array([x[0] for x in self.ids], np.int64)
        ends = np.cumsum([len(leaf) for part in parts for leaf in part])
        self.leaves = list(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True))
        self.leaf_label = self.label[[a for a, _ in self.leaves]]
        self.leaf_low, self.leaf_high = (np.stack([f(self.rows[a:b], axis=0) for a, b in self.leaves]) for f in (np.min, np.max))
        self.inner, at = [], 0
        for part in parts:
            self.inner += [(at + i, min(at + i + FAN, at + len(part))) for i in range(0, len(part), FAN)]
            at += len(part)
        self.inner_label = self.leaf_label[[a for a, _ in self.inner]]
        self.inner_low = np.stack([self.leaf_low[a:b].min(axis=0) for a, b in self.inner])
        self.inner_high = np.stack([self.leaf_high[a:b].max(axis=0) for a, b in self.inner])

    def _packed(self, rows: np.ndarray, own: np.ndarray, spread: list[int]) -> list[np.ndarray]:
        """Sort-tile-recursion: slabs along one coordinate, each cut along the next, until a slab is a leaf."""
        if len(own) <= LEAF:
            return [own]
        own = own[np.argsort(rows[own, spread[0]], kind="stable")] if spread else own
        leaves = -(-len(own) // LEAF)
        slabs = leaves if len(spread) <= 1 else max(2, int(np.ceil(np.sqrt(leaves))))
        return [leaf for slab in np.array_split(own, slabs) for leaf in self._packed(rows, slab, spread[1:])]

    def search(self, queries: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(query, window, row, score) of the ``k`` best rows of every query and window: highest scores first, then least ids."""
        m, w = low.shape
        best, least_id = np.full((m, w, k), LEAST), np.full((m, w, k), 2**63 - 1)
        row = np.full((m, w, k), -1)
        kth = kth.copy()
        inner_least, inner_most = bounds(queries, self.inner_low, self.inner_high)
        fits = (label[:, None] == self.inner_label[None, :]) == same
        reach = reaching(inner_least, inner_most, fits, low, high, kth)
        queue = [(-float(inner_most[reach[:, i], i].max()), 0, i) for i in range(len(self.inner)) if reach[:, i].any()]
        heapq.heapify(queue)
        while queue:
            _, leaf, i = heapq.heappop(queue)
            box = (self.leaf_low, self.leaf_high, self.leaf_label) if leaf else (self.inner_low, self.inner_high, self.inner_label)
            some = np.flatnonzero((label == box[2][i]) == same)
            least, most = bounds(queries[some], box[0][i:i + 1], box[1][i:i + 1])
            some = some[reaching(least, most, np.ones(least.shape, bool), low[some], high[some], kth[some])[:, 0]]
            if not len(some):
                continue
            if not leaf:
                a, b = self.inner[i]
                least, most = bounds(queries[some], self.leaf_low[a:b], self.leaf_high[a:b])
                reach = reaching(least, most, np.ones(least.shape, bool), low[some], high[some], kth[some])
                for j in range(b - a):
                    if reach[:, j].any():
                        heapq.heappush(queue, (-float(most[reach[:, j], j].max()), 1, a + j))
                continue
            a, b = self.leaves[i]
            got = scores(queries[some], self.rows[a:b])
            for x in range(w):
                inside = (got >= np.maximum(low[some, x], kth[some, x])[:, None]) & (got <= high[some, x][:, None])
                hit = np.flatnonzero(inside.any(axis=1))
                if not len(hit):
                    continue
                to = some[hit]
                value = np.concatenate([best[to, x], np.where(inside[hit], got[hit], LEAST)], axis=1)
                ident = np.concatenate([least_id[to, x], np.where(inside[hit], self.least_id[None, a:b], 2**63 - 1)], axis=1)
                where = np.concatenate([row[to, x], np.where(inside[hit], np.arange(a, b)[None, :], -1)], axis=1)
                first = np.lexsort((ident, -value), axis=-1)[:, :k]
                best[to, x], least_id[to, x], row[to, x] = (np.take_along_axis(y, first, axis=1) for y in (value, ident, where))
                kth[to, x] = np.maximum(kth[to, x], best[to, x, k - 1])
        q, x, n = np.nonzero(row >= 0)
        return q, x, row[q, x, n], best[q, x, n]


def _stacked(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """Lists of integers as rows of a table, filled up to the longest by empty windows."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), LEAST, kind)
    for r, values in zip(out, lists, strict=True):
        r[:len(values)] = values
    return out


_CLASS = [("cid", "long"), ("label", "long"), ("v", "array<long>"), ("ids", "array<long>")]
_QUERY = [("low", "array<long>"), ("high", "array<long>"), ("kth", "array<long>"), ("of", "array<long>")]
_BOX = pa.schema([("page", pa.int64()), ("label", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
_REACHED = pa.schema([("cid", pa.int64()), ("page", pa.int64()), ("most", pa.float64())])
_FOUND = pa.schema([("cid", pa.int64()), ("of", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])


def _longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The box of each label of a page; a page may come in several pieces, and then has several boxes."""
    for key, part, _ in groups(batches, ["page"]):
        rows, label = _longs(part.column("v")), part.column("label").to_numpy()
        kinds = np.unique(label)
        out = [np.full(len(kinds), key[0]), kinds, [rows[label == x].min(axis=0) for x in kinds], [rows[label == x].max(axis=0) for x in kinds]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BOX, strict=True)], schema=_BOX)


def _directory(same: bool):
    """Pages whose boxes a query reaches into; the boxes of a block come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for _, part, new in groups(batches, ["block"]):
            held = [] if new else held
            n = int((part.column("kind").to_numpy() == 0).sum())
            if n:
                held.append(part.slice(0, n))
            if n < part.num_rows and held:
                low, high = (np.concatenate([_longs(h.column(c)) for h in held]) for c in ("low", "high"))
                page, label = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in ("page", "label"))
                for at in range(n, part.num_rows, TOGETHER):
                    q = part.slice(at, TOGETHER)
                    least, most = bounds(_longs(q.column("v")), low, high)
                    fits = (q.column("label").to_numpy()[:, None] == label[None, :]) == same
                    i, j = np.nonzero(reaching(least, most, fits, *(_stacked(q.column(c)) for c in ("low", "high", "kth"))))
                    yield pa.RecordBatch.from_arrays([pa.array(q.column("cid").to_numpy(zero_copy_only=False)[i].astype(np.int64)), pa.array(page[j].astype(np.int64)), pa.array(most[i, j])], schema=_REACHED)

    return arrow_map(run, _REACHED)


def _visits(k: int, same: bool):
    """The best rows of a page for the queries that visit it; the page's rows come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        page = None
        for _, part, new in groups(batches, ["page"]):
            if new:
                held, page = [], None
            n = int((part.column("kind").to_numpy() == 0).sum())
            if n:
                held.append(part.slice(0, n))
            for at in range(n, part.num_rows, TOGETHER):
                q = part.slice(at, TOGETHER)
                if page is None:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    page = Page(_longs(rows.column("v")), rows.column("label").to_numpy(), rows.column("cid").to_numpy(), rows.column("ids").to_pylist())
                low, high, kth, of = (_stacked(q.column(c)) for c in ("low", "high", "kth", "of"))
                i, x, r, score = page.search(_longs(q.column("v")), q.column("label").to_numpy(), low, high, kth, k, same)
                ids = [page.ids[j] for j in r.tolist()]
                n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
                out = [np.repeat(q.column("cid").to_numpy()[i], n_ids), np.repeat(of[i, x], n_ids), np.repeat(score, n_ids), [y for z in ids for y in z], np.repeat(page.number[r], n_ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return arrow_map(run, _FOUND)


def _filled(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns if c not in df.columns})


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query and window."""
    order = Window.partitionBy("cid", "of").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(pages: DataFrame, boxes: DataFrame, blocks: int, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows for each query and window of ``queries`` (cid, label, v, low, high, of)."""
    asked = queries.withColumn("kth", F.transform("low", lambda x: F.lit(LEAST)))
    shape = [("page", "long"), ("label", "long"), ("low", "array<long>"), ("high", "array<long>"), ("kth", "array<long>"), ("cid", "long"), ("v", "array<long>")]

    def reached(asked: DataFrame) -> DataFrame:
        doors = _filled(boxes.withColumn("kind", F.lit(0)), shape)
        each = _filled(asked.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "kind": F.lit(1)}).drop("of"), shape)
        met = dealt(doors.unionByName(each.select(doors.columns)), ["block"], "kind").mapInArrow(_directory(same), "cid long, page long, most double")
        return met.groupBy("cid", "page").agg(F.max("most").alias("most"))

    def visited(asked: DataFrame, to: DataFrame) -> DataFrame:
        full = [("page", "long"), ("kind", "int"), *_CLASS, *_QUERY]
        going = _filled(asked.join(to.select("cid", "page"), "cid").withColumn("kind", F.lit(1)), full)
        rows = _filled(pages.join(to.select("page").distinct(), "page", "left_semi").withColumn("kind", F.lit(0)), full)
        names = [c for c, _ in full]
        return dealt(rows.select(names).unionByName(going.select(names)), ["page"], "kind").mapInArrow(_visits(k, same), "cid long, of long, score long, vec_id long, row long")

    near = materialise(reached(asked), "reached")
    best = Window.partitionBy("cid").orderBy(F.desc("most"), "page")
    first = near.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    found = materialise(_first(visited(asked, first), k), "first")
    # What the first page gave bounds the k-th score of each window from below.
    known = found.where(F.col("rank") == k).groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("of", "score"))).alias("got"))
    asked = asked.join(known, "cid", "left").withColumn("kth", F.when(F.col("got").isNotNull(), F.transform("of", lambda x: F.coalesce(F.try_element_at("got", x), F.lit(LEAST)))).otherwise(F.col("kth"))).drop("got")
    again = reached(materialise(asked, "asked")).join(first.select("cid", "page"), ["cid", "page"], "left_anti")
    more = visited(asked, materialise(again, "again"))
    return materialise(_first(found.drop("rank").unionByName(more), k), "found")


_TILED = pa.schema([("tile", pa.int64()), ("next", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("key", pa.int64()), ("asks", pa.bool_())])


def mine(vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95, page: int = PAGE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row that ``anchor`` marks and each of its
    ``positives`` best other rows of its label, the best ``negatives`` rows of other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``. Higher scores come first, ties by smaller id; fewer rows come where there are fewer.

    Rows with a null label, id or vector, an empty vector, null or non-finite components, a vector of another length than most, or a vector whose score with itself does
    not fit a long take no part; zero vectors do. Rows that repeat id, label and vector are one row; rows that share an id only are rows
    of their own. Extra columns, whatever their names, are left out. Without rows or anchors nothing is returned.
    """
    spark = vectors.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    some = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("v") > 0)
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + F.pow(F.floor(x * float(scale)).cast("double"), F.lit(2.0)))
    good = some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return empty
    # A component that floor() would cut at the bounds of a long has a square beyond them anyway.
    good = good.where((F.size("v") == usual["d"]) & (square < float(2**62))).withColumn("key", wide_hash("v"))
    by = Window.partitionBy("label", "key").orderBy("vec_id")
    few = good.withColumn("_r", F.dense_rank().over(by)).where(F.col("_r") <= max(positives + 1, negatives))
    ids = few.groupBy("label", "key").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    marked = materialise(good.where("asks").select(F.col("vec_id").alias("anchor_id"), "label", "key").distinct(), "anchors")
    classes = materialise(ids.join(marked.select("label", "key", F.lit(True).alias("asks")).distinct(), ["label", "key"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "classes")
    n = classes.count()
    if not n or not marked.take(1):
        return empty
    every = max(1, n // SAMPLE)
    sample = whole(np.stack(classes.where(F.pmod(F.xxhash64(F.lit(5), "key", "label"), F.lit(every)) == 0).limit(MOST_SAMPLE).select("v").toPandas()["v"].to_list() or [np.zeros(usual["d"])]).astype(float), scale)
    wanted = min(TILES, -(-n // page))
    depth = max(0, min(usual["d"] - 1, int(np.log2(wanted)) // 2))
    each = max(2, int(np.ceil(wanted ** (1 / depth)))) if depth else 2
    spread = np.argsort(-sample.astype(float).var(axis=0), kind="stable").tolist()
    cuts, further = tiles(sample, spread, each, depth), spread[depth]

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = whole(matrix(batch.column("v")), scale)
                bounds_ = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(tile_of(rows, cuts, each, depth)), pa.array(rows[:, further]), batch.column("label"), pa.ListArray.from_arrays(
                    bounds_, pa.array(rows.reshape(-1))), batch.column("ids"), batch.column("key"), batch.column("asks")], schema=_TILED)

    flat = classes.select("label", "v", "ids", F.xxhash64("key").alias("key"), "asks")
    placed = flat.mapInArrow(arrow_map(tiled, _TILED), "tile long, next long, label long, v array<long>, ids array<long>, key long, asks boolean")
    placed = positions(placed, ["tile", "next", "label", "key"], out="cid")
    pages = materialise(placed.select(F.floor(F.col("cid") / page).cast("long").alias("page"), "cid", "label", "v", "ids", "asks", "key"), "pages")
    boxes = materialise(dealt(pages.select("page", "label", "v"), ["page"]).mapInArrow(arrow_map(_boxes, _BOX), "page long, label long, low array<long>, high array<long>"), "boxes")
    blocks = -(-boxes.count() // BOXES)
    boxes = boxes.withColumn("block", F.pmod(F.xxhash64("page", "label"), F.lit(blocks)))

    asking = pages.where("asks").select("cid", "label", "v")
    nowhere = {"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(-LEAST)), "of": F.array(F.lit(0).cast("long"))}
    top = _search(pages, boxes, blocks, asking.withColumns(nowhere), positives + 1, True)
    p = F.col("score")
    part, hundreds = F.pmod(p, F.lit(100)), (p - F.pmod(p, F.lit(100))) / 100
    window = {"low": hundreds.cast("long") * low + F.ceil(part * low / 100).cast("long"), "high": hundreds.cast("long") * high + F.floor(part * high / 100).cast("long")}
    windows = top.select("cid", "score").distinct().select("cid", F.struct(p.alias("of"), window["low"].alias("low"), window["high"].alias("high")).alias("w")).where("w.low <= w.high")
    windows = windows.groupBy("cid").agg(F.sort_array(F.collect_list("w")).alias("w")).select("cid", *(F.col(f"w.{c}").alias(c) for c in ("low", "high", "of")))
    below = _search(pages, boxes, blocks, asking.join(windows, "cid"), negatives, False)

    best = top.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("last"), "vec_id", "row", "score")), asc=False).alias("best"))
    worst = below.groupBy("cid", F.col("of").alias("positive_score")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hard"))
    numbered = marked.select("anchor_id", "label", F.xxhash64("key").alias("key")).join(pages.where("asks").select("label", "key", "cid"), ["label", "key"])
    pairs = numbered.join(best, "cid").select("anchor_id", "cid", F.explode(F.slice(F.filter("best", lambda x: (x["vec_id"] != F.col("anchor_id")) | (x["row"] != F.col("cid"))), 1, positives)).alias("x"))
    pairs = pairs.select("anchor_id", "cid", F.col("x.vec_id").alias("positive_id"), F.col("x.score").alias("positive_score"))
    out = pairs.join(worst, ["cid", "positive_score"]).select("anchor_id", "positive_id", F.explode("hard").alias("x"), "positive_score")
    return out.select("anchor_id", "positive_id", F.col("x.rank").cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
