"""The operators of this folder as queries, each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfsense.llm import alignment, bitpack, bytebpe, hardneg, jaccard, neardup_vectors, neighbours, packing, piecebpe, pitman_yor, quality, secrets, sharding
from rfsense.llm.common import read
from rfsense.session import workdir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD_IDS = 49_408
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(read(spark, sf_dir, "embeddings"), 0.93)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), WORD_BPE, 2048, 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(read(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), 4, 85)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, and where it goes once the last shard is gone."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    placed = sharding.place(docs, "doc_id", SHARDS)
    return sharding.place(placed, "doc_id", SHARDS[:-1], out="shard_without_last", slot="_slot").drop("_slot")


def op9_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = workdir(spark, "token-blocks")
    bitpack.write(read(spark, sf_dir, "documents"), WORD_BPE, WORD_IDS, 1, target)
    return bitpack.read_documents(spark, target)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by seven move on by one, so that some labels are wrong."""
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), BYTE_BPE_JSON, PIECES)


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.digests(read(spark, sf_dir, "documents"), PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicate_vectors, op2_packing, op3_quality, op4_byte_bpe, op5_secrets, op6_pitman_yor, op7_jaccard, op8_sharding, op9_bitpack, op10_neighbours,
                             op11_hard_negatives, op12_token_alignment, op13_piece_bpe)
}

ORACLES: dict[str, str] = {
    "op11_hard_negatives": """
        with r as (
            select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
            from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        p as (select *, row_number() over (partition by anchor_id order by score desc, other_id) as k from s where same),
        n as (
            select p.anchor_id, p.other_id as positive_id, s.other_id as negative_id, p.score as positive_score, s.score as negative_score,
                row_number() over (partition by p.anchor_id, p.other_id order by s.score desc, s.other_id) as place
            from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
            where k <= 5)
        select anchor_id, positive_id, place::int as rank, negative_id, positive_score, negative_score from n where place <= 3""",
}
