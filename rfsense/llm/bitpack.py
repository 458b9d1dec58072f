"""Token ids in fixed-width bit-packed blocks, with block offsets for random access.

The file format is a folder of Parquet files, one row per block, ordered by ``first`` (the number of ids before the block in
the whole collection). Parquet carries the bytes, so the files go to any store Spark can write to, and only the
files of tasks that ended well count. A block holds whole documents; it is closed once it has ``block_ids`` ids, or at the end of a slice of
text that a worker encodes at a time:

* ``first`` long, ``n_ids`` long, ``bits`` int
* ``doc_ids`` long[], ``ends`` long[]: the documents in order, and where each ends in the block
* ``payload``: id k takes the bits ``k * bits`` to ``(k + 1) * bits - 1``, the lowest bit first, in little-endian order;
  the last byte is filled with zeros.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rfsense.llm.common import arrow_map, give_back, slices, texts_of
from rfsense.llm.wordbpe import encoder

BLOCK_IDS = 1 << 18

BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("inside", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little") if len(ids) else np.zeros(0, np.uint8)
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n - 1`` of a block; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    lo, hi = first * bits // 8, -(-(first + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, hi - lo, lo), bitorder="little")
    skip = first * bits - lo * 8
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :bits] = flat[skip:skip + n * bits].reshape(n, bits)
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


def write(docs: DataFrame, path: str, vocabulary: int, end_id: int, target: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode all whole texts, append ``end_id`` to each and write blocks in ascending ``doc_id`` (null first) order.

    Documents with one ``doc_id`` go by a hash of their text, then by text, so repeated rows have a defined order. A null text is empty: its document holds
    the end id alone.
    """
    from pyspark import TaskContext

    bits = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        docs_in: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        block = before = 0

        def close() -> pa.RecordBatch:
            nonlocal block, before
            ids, ends = np.concatenate(held), np.cumsum(sizes)
            row = [[part], [block], [before], [len(ids)], [bits], [list(docs_in)], [ends.tolist()], [pack_bits(ids, bits)]]
            block, before = block + 1, before + len(ids)
            for x in (docs_in, sizes, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        for cut in slices(batches):
            ids, counts = enc.encode(cut.column("text"))
            at = waiting = 0
            for doc, n in zip(cut.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                held += [ids[at:at + n], np.array([end_id], np.uint32)]
                at += n
                docs_in.append(doc)
                sizes.append(n + 1)
                waiting += n + 1
                if waiting >= block_ids:
                    yield close()
                    waiting = 0
            if sizes:
                yield close()
        enc.clear()
        give_back()

    # What the ranges are sampled from goes to the driver: a number, not the text.
    hashed = texts_of(docs, F.xxhash64("text").alias("_hash"))
    ordered = hashed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    blocks = ordered.select("doc_id", "text").mapInArrow(arrow_map(run, BLOCKS), "part int, block int, inside long, n_ids long, bits int, "
                                "doc_ids array<long>, ends array<long>, payload binary")
    blocks.write.mode("error").option("compression", "none").parquet(target)


def blocks(spark: SparkSession, target: str) -> DataFrame:
    """The blocks of a folder with ``first``; the offsets of the files come from one row per file."""
    df = spark.read.parquet(target)
    totals = df.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = totals.select("part", F.coalesce(F.sum("_n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return df.join(F.broadcast(before), "part").withColumn("first", F.col("_before") + F.col("inside")).drop("_before", "inside")


DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    schema = DIGEST.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], row["bits"], 0, row["n_ids"])
                ends = np.array(row["ends"])
                starts = np.concatenate(([0], ends[:-1]))
                own = [ids[a:b].astype("<u4") for a, b in zip(starts.tolist(), row["ends"], strict=True)]
                out = [row["doc_ids"], starts + row["first"], ends - starts, [zlib.crc32(x.tobytes()) for x in own], own]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=False)], schema=schema)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks(spark, target).select("first", "n_ids", "bits", "doc_ids", "ends", "payload").mapInArrow(arrow_map(run, schema), ddl)


IDS = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_ids(spark: SparkSession, target: str, first: int, n: int) -> DataFrame:
    """Ids ``first`` to ``first + n - 1`` of the whole collection, one row for each block that holds some: ``start`` and ``ids``.

    Only the blocks of the range are read, and of these only the bytes that hold it; what lies beyond the collection is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(first, row["first"]), min(first + n, row["first"] + row["n_ids"])
                ids = unpack_bits(row["payload"], row["bits"], a - row["first"], b - a)
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([ids.astype(np.int32)], IDS.field("ids").type)], schema=IDS)

    near = blocks(spark, target).where((F.col("first") < first + n) & (F.col("first") + F.col("n_ids") > first))
    return near.select("first", "n_ids", "bits", "payload").mapInArrow(arrow_map(run, IDS), "start long, ids array<int>")


def read_document(spark: SparkSession, target: str, doc_id: int) -> DataFrame:
    """The ids of the documents with this id, end id included: ``start`` and ``ids``, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for k in (i for i, d in enumerate(row["doc_ids"]) if d == doc_id):
                    a, b = row["ends"][k - 1] if k else 0, row["ends"][k]
                    ids = unpack_bits(row["payload"], row["bits"], a, b - a)
                    yield pa.RecordBatch.from_arrays([pa.array([row["first"] + a]), pa.array([ids.astype(np.int32)], IDS.field("ids").type)], schema=IDS)

    near = blocks(spark, target).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return near.select("first", "bits", "doc_ids", "ends", "payload").mapInArrow(arrow_map(run, IDS), "start long, ids array<int>")
