"""Pieces: every row owned once, positions and look-back right, whatever the cut."""

import pytest
from pyspark.sql import functions as F

from rfsense.operators.layout import arrange


def skewed(spark):
    """One device with most rows, bursts of equal times, and small devices."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 13).cast("long").alias("device_id"),
        F.timestamp_seconds(F.floor(F.col("id") / 40) * 17 + F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 40)).alias("ts"),
        F.col("id").alias("seq"), (F.col("id") * 7919 % 1009).cast("double").alias("x"))


@pytest.mark.parametrize("piece_rows,before,after", [(50, 0, 0), (50, 7, 1), (200, 150, 0), (33, 33, 1)])
def test_pieces_agree_with_the_whole(spark, piece_rows, before, after):
    df = skewed(spark)

    def run(lay):
        w = lay.last_n(before + 1)
        out = lay.df.withColumn("p", lay.pos()).withColumn("n", lay.total()) \
            .withColumn("s", F.sum("x").over(w)).withColumn("c", F.count("x").over(w))
        if after:
            out = out.withColumn("nxt", F.lead("seq").over(lay.ordered()))
        out = lay.carry(out, {"k": F.when(F.col("x") > 1000, F.col("x"))}, inclusive=False)
        out = lay.first_of(out, F.col("x"), "f")
        out = lay.done(out).drop("ts")
        return sorted(map(str, out.collect()))

    cut, whole = arrange(df, before, after, piece_rows=piece_rows, bin_width=5.0), arrange(df, before, after)
    assert cut.pieces and not whole.pieces
    sizes = cut.df.where("_core").groupBy("device_id", "_piece").count()
    assert sizes.where("device_id = 0").count() > 3
    assert run(cut) == run(whole)


def test_shuffled_lookup_when_the_map_is_too_large_to_broadcast(spark):
    df = skewed(spark)
    lay = arrange(df, 3, piece_rows=50, bin_width=5.0, broadcast_rows=2)
    assert lay.done(lay.df).count() == 3000
    assert lay.done(lay.df).select("seq").distinct().count() == 3000


def test_only_hot_devices_are_cut(spark):
    lay = arrange(skewed(spark), 3, piece_rows=500, bin_width=5.0)
    many = lay.df.groupBy("device_id").agg(F.count_distinct("_piece").alias("n")).where("n > 1").collect()
    assert [r.device_id for r in many] == [0]


@pytest.mark.parametrize("bin_seconds", [0.25, 60.0])
def test_machines_over_long_heartbeats_and_one_bin(spark, monkeypatch, bin_seconds):
    """A heartbeat of 300 rows over pieces of 40; with wide bins all rows lie in the first one, which is made narrower."""
    from rfsense.operators import detect as D
    from rfsense.operators import layout

    monkeypatch.setattr(layout, "BIN_SECONDS", bin_seconds)
    rows = spark.range(1500).select((F.col("id") % 3 % 2).cast("long").alias("device_id"), F.timestamp_millis(F.col("id") * 3).alias("ts"), F.col("id").alias("seq"),
                                    F.when(F.col("id") % 431 < 9, "DETECTED").otherwise("IDLE").alias("state"), (F.col("id") % 700 / 700).alias("score"))

    def run(piece_rows):
        gate = D.gate(rows, 0.2, 3000, piece_rows=piece_rows)
        found = D.detect(rows, 0.9, 4, 1, piece_rows=piece_rows)
        return sorted(map(str, gate.select("device_id", "seq", "published").collect())), sorted(map(str, found.select("device_id", "seq", "state").collect()))

    assert arrange(rows, piece_rows=40).pieces and run(40) == run(10**6)
    pieces = arrange(rows, piece_rows=40).df.where("_core").groupBy("device_id", "_piece").count()
    assert pieces.agg(F.max("count")).first()[0] <= 80 and pieces.count() > 20
