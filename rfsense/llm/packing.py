"""Best-fit packing of documents into sequences of a fixed number of tokens.

Large-item matching. Pieces longer than a third of a sequence pair at most twice: taken from the longest down, each is
matched with the longest other one that still fits. Smaller pieces, from the longest down, go to the fullest
sequence that still has room. All pieces of one length are alike, so the plan is made on the histogram of lengths
(never more rows than a sequence has tokens) and says which ranks of each length go where; the ranks of the pieces
are counted in Spark. The result is that of packing all pieces of all documents in one go, at any size.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, give_back, slices, texts_of
from rfsense.llm.wordbpe import encoder
from rfsense.session import materialise

SLICE = 1 << 20
"""Bytes of text that a worker encodes at a time; ids and their places take some sixty times that on the way."""

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
PIECES_WITH_IDS = PIECES.append(pa.field("ids", pa.list_(pa.int32())))


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: the ids of the whole text, then ``end_id``; only longer documents are cut, at ``capacity``.

    A null text counts as empty. A document without any id (empty, and no ``end_id``) has no piece.
    """
    schema = PIECES_WITH_IDS if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches, size=SLICE):
            ids, counts = enc.encode(part.column("text"))
            out: list[list] = [[] for _ in schema]
            at = 0
            for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = ids[at:at + n].astype("<u4")
                at += n
                if end_id is not None:
                    own = np.append(own, np.uint32(end_id))
                for k, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start:start + capacity]
                    for column, value in zip(out, (doc, k, start, len(cut), zlib.crc32(cut.tobytes()), cut), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        enc.clear()
        give_back()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts_of(docs).mapInArrow(arrow_map(run, schema), ddl)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for ``counts[length]`` pieces of each length: rows of (length, first rank, pieces, first sequence, pieces
    in each sequence, offset of the first in it), and the number of sequences.

    All but the last sequence of a row are filled with its pieces; the last may get fewer.
    """
    left = {k: v for k, v in counts.items() if v}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences with that room: first sequence, sequences
    rooms: list[int] = []  # sorted keys of runs
    made = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        rows.append((length, rank[length], n, first, each, offset))
        rank[length] += n
        left[length] -= n

    def have(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            heapq.heappush(runs[room], (first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None or a == b and left[a] == 1:
            if b is not None and at > 0:  # the last of its length: a shorter partner
                b, at = large[at - 1], at - 1
                n = 1
            else:
                b, n = None, left[a]
        else:
            n = left[a] // 2 if a == b else min(left[a], left[b])
        put(a, n, made, 1, 0)
        if b is not None:
            put(b, n, made, 1, a)
        have(capacity - a - (b or 0), made, n)
        made += n
        large = [k for k in large if left[k]]

    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                n = -(-left[length] // each)
                have(capacity, made, n)
                made += n
                continue
            room = rooms[at]
            first, n = heapq.heappop(runs[room])
            if not runs[room]:
                del runs[room], rooms[at]
            each = room // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - room)
                have(room - each * length, first, full)
            if full < n:
                some = left[length]
                if some:  # fewer than would fill one more
                    put(length, some, first + full, some, capacity - room)
                    have(room - some * length, first + full, 1)
                    full += 1
                have(room, first + full, n - full)
    return rows, made


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """``found`` (rows with ``doc_id``, ``piece``, ``length``) with ``sequence_id`` and ``offset``.

    Ranks within a length are counted per length and salt, so that a length which holds a third of all pieces is spread over
    many tasks. Every input column stays; rows that repeat are packed as often as they come.
    """
    spark = found.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    cells = materialise(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    # At most one row for each length up to the capacity.
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("_n")).collect()}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    rows, _ = plan(counts, capacity)
    places = spark.createDataFrame(rows, "length long, _rank long, _pieces long, _first long, _each long, _offset long")
    before = cells.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ties = ["doc_id", "piece", *(c for c in ("ids_crc32",) if c in found.columns)]
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*ties)) - 1)
    # The cells meet rows that are dealt out by the same keys already. The plan has a few rows per length: bounded by the capacity.
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_r", F.col("_r") + F.col("_before"))
    at = F.col("_r") - F.col("_rank")
    return (
        ranked.join(F.broadcast(places), "length")
        .where((at >= 0) & (at < F.col("_pieces")))
        .withColumn("sequence_id", F.col("_first") + F.floor(at / F.col("_each")))
        .withColumn("offset", F.col("_offset") + at % F.col("_each") * F.col("length"))
        .select(*found.columns, "sequence_id", "offset")
    )


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; ``with_ids`` adds the ids themselves.

    Rows come back for null texts (one piece, the end id alone), null ``doc_id`` and repeated documents. An empty table gives
    an empty result. The pieces are written once: they are counted, then placed.
    """
    return pack(materialise(pieces(docs, path, capacity, end_id, with_ids), "pieces"), capacity)
