"""A corpus from raw documents to packed sequences: quality, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfsense.llm import jaccard, packing, quality, secrets
from rfsense.llm.common import read
from rfsense.llm.queries import WORD_BPE
from rfsense.session import ship, workdir

MASK = "[SECRET]"

BATCH_BYTES = 1 << 20
"""Bytes of an Arrow batch between executor and Python worker; 10,000 rows of whole texts would be many times that. Both hold
several copies of a batch outside of the heap, and a worker's slices are no larger than its batches."""


def _prepare(spark: SparkSession) -> None:
    """Called by every stage: what it returns is run later, under the session's settings."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _prepare(spark)
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, similarity 0.8 or more) the document with the least id; texts that differ under one id are documents of their own."""
    _prepare(spark)
    return jaccard.deduplicated(docs, 5, 80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and ``n_chars`` counted again where one was."""
    _prepare(spark)
    columns = docs.columns
    rest = tuple(c for c in columns if c not in ("doc_id", "text"))
    prefix = "_" * (1 + max(len(c) for c in columns))  # longer than any name there is
    clean = secrets.scan(docs, secrets.train(docs), keep=rest, mask=MASK, out=tuple(prefix + c for c in ("starts", "ends", "kinds")))
    changed = F.when(F.size(prefix + "kinds") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*(f"`{c}`" for c in columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    _prepare(spark)
    return packing.packed(docs, WORD_BPE, 2048, 0)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's documents."""
    _prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = workdir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Trained models and a tokenizer take part: SQL cannot express the rows. tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None
