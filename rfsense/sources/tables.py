"""Packet, series and command views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from(emb: DataFrame) -> DataFrame:
    """Packet schema over vectors: 20 packets a second, three devices of unequal size."""
    d = F.col("vec_id") % 10
    return emb.select(
        F.when(d < 5, 0).when(d < 8, 1).otherwise(2).cast("long").alias("device_id"),
        F.col("vec_id").alias("seq"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("vec_id") * 50000).alias("ts"),
        F.when(F.col("label") < 5, "BASELINE").otherwise("MOVEMENT").alias("phase"),
        F.transform("embedding", lambda e: F.round(e.cast("double") * 127).cast("int")).alias("iq"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(table(spark, sf_dir, "embeddings"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_from(table(spark, sf_dir, "events"))


def series_from(events: DataFrame) -> DataFrame:
    """Scalar series per user."""
    return events.select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("x"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("score"),
    )


SERIES_BIG_ORDER = ("ts", "seq", "l_linenumber", "l_partkey", "l_quantity", "x")


def series_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price series per supplier; the long order key makes the order unique."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("device_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_orderkey").alias("seq"),
        "l_linenumber", "l_partkey", "l_quantity",
        F.col("l_extendedprice").alias("x"),
    )


def calibration_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON ``calibrate`` messages between the packets: sessions, a refused and an invalid start, stops and status questions."""
    return calibration_commands_from(packets(spark, sf_dir))


def calibration_commands_from(packets: DataFrame) -> DataFrame:
    texts = {1: '"action":"start","samples":50', 3: '"action":"start","samples":60', 5: '"action":"status"', 12: '"action":"status"', 14: '"action":"stop"',
             15: '"action":"start","samples":20', 16: '"action":"start","samples":55,"verbose":true', 20: '"action":"status"', 22: '"action":"pause"'}
    at = F.floor(F.col("seq") / 10) % 25
    text = F.lit(None).cast("string")
    for k, what in texts.items():
        text = F.when(at == k, '{"cmd":"calibrate",' + what + "}").otherwise(text)
    return packets.where((F.col("seq") % 10).isin(0, 5, 8)).select("device_id", "seq", "ts", text.alias("message")).where("message is not null")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON command log per user: valid, out-of-range, unknown and malformed messages."""
    k = F.from_json("props", "k DOUBLE")["k"].cast("long")

    def msg(cmd: str, value) -> F.Column:
        return F.format_string(f'{{"cmd":"{cmd}","value":%s}}', value.cast("string"))

    t = F.col("event_type")
    text = (
        F.when(t == "click", msg("threshold", k / 100.0))
        .when(t == "view", msg("debounce", k % 12))
        .when(t == "purchase", msg("persistence", k % 40))
        .when(t == "signup", F.when(k == 0, F.lit('{"cmd":"factory_reset"}'))
              .otherwise(msg("hysteresis", k / 80.0)))
        .otherwise(F.when(k % 4 == 0, F.lit('{"cmd":"self_destruct"}'))
                   .when(k % 4 == 1, F.lit('{"value":1}'))
                   .when(k % 4 == 2, F.lit("{oops"))
                   .otherwise(F.lit('{"cmd":"logs","enabled":true}')))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        text.alias("message"),
    )
