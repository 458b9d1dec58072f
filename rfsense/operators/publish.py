"""From states to events: ticks, rates, occupancy, alerts, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense.functions import packet as P
from rfsense.operators import layout
from rfsense.operators.layout import Profile, arrange
from rfsense.operators.ticks import tick_of

GAP_TICKS = 4096
"""Ticks of a gap that are made from one row at a time."""


def ticks(states: DataFrame, period_seconds: int = 1, cols: tuple[str, ...] = ("state", "score", "confidence"),
          piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """Latest values at every tick, carried over ticks without a packet.

    Each row covers the ticks from its own time to just before the next row's, so no tick
    calendar is built and nothing is joined.
    """
    us = period_seconds * 1_000_000
    lay = arrange(states, after=1, piece_rows=piece_rows, profile=profile)
    rows = lay.done(lay.df.withColumn("_next", F.lead("ts").over(lay.ordered())))
    rows = rows.withColumn("_first", tick_of(F.col("ts"), period_seconds))
    rows = rows.withColumn("_last", F.coalesce(tick_of(F.col("_next"), period_seconds) - 1, F.col("_first")))
    first, last = F.col("_first"), F.col("_last")
    # A long gap is spread in two steps: no row holds all its ticks.
    spread = rows.withColumn("_from", F.explode(F.when(last >= first, F.sequence(first, last, F.lit(GAP_TICKS).cast("long")))))
    spread = spread.withColumn("_k", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (GAP_TICKS - 1), last))))
    return spread.select("device_id", F.timestamp_micros(F.col("_k") * us).alias("ts"), *cols)


def tick_profile(times: DataFrame, period_seconds: int = 1, piece_rows: int | None = None, profile: Profile | None = None) -> Profile:
    """How the ticks of ``times`` spread: a device has all those from its first row to its last, so none is built unless there is a hot device."""
    span = times.groupBy("device_id").agg((tick_of(F.max("ts"), period_seconds) - tick_of(F.min("ts"), period_seconds) + 1).alias("n"))
    biggest, devices = span.agg(F.max("n"), F.count(F.lit(1))).first()
    most = max(int(piece_rows or layout.PIECE_ROWS), 1)
    if (biggest or 0) <= most:
        return Profile(["device_id"], False, devices, span, layout.BIN_SECONDS, most)
    return layout.measure(ticks(times.select("device_id", "ts", "seq"), period_seconds, (), piece_rows, profile), order=("ts",), piece_rows=piece_rows)


def reduction(published: DataFrame) -> DataFrame:
    """Sent and held-back rows per device, and the saving in percent."""
    sent = F.count_if(F.col("published"))
    held = F.count_if(~F.col("published"))
    return published.groupBy("device_id").agg(
        sent.alias("published"), held.alias("skipped"),
        (held * 100.0 / (sent + held)).alias("reduction_pct"))


def packet_rate(packets: DataFrame, admitted: Column | None = None) -> DataFrame:
    """Packets per device and second, with the share processed."""
    ok = P.admitted(F.col("iq")) if admitted is None else admitted
    return (
        packets.groupBy("device_id", F.window("ts", "1 second").alias("w"))
        .agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("processed"))
        .select("device_id", F.col("w.start").alias("second"), "received", "processed",
                (F.col("received") - F.col("processed")).alias("dropped"),
                (F.col("processed") * 100.0 / F.col("received")).alias("success_pct"))
    )


def occupancy(states: DataFrame, zone: Column, window: str = "1 hour") -> DataFrame:
    """Per zone and window: whether any device detected motion, and how many did."""
    hit = F.col("state") == "DETECTED"
    return (
        states.groupBy(zone.alias("zone"), F.window("ts", window).alias("w"))
        .agg(F.bool_or(hit).alias("occupied"), F.max("score").alias("peak"),
             F.count_distinct(F.when(hit, F.col("device_id"))).alias("devices"))
        .select("zone", F.col("w.start").alias("window_start"), "occupied", "peak", "devices")
    )


def movement_alerts(states: DataFrame, movement: float = 0.6, confidence: float = 0.7,
                    piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """Rows on which movement and confidence first both exceed their limits."""
    lay = arrange(states, before=1, piece_rows=piece_rows, profile=profile)
    hot = (F.col("score") > movement) & (F.col("confidence") > confidence)
    df = lay.df.withColumn("_hot", hot)
    df = df.withColumn("_was", F.coalesce(F.lag("_hot").over(lay.ordered()), F.lit(False)))
    return lay.done(df).where("_hot and not _was").select("device_id", "ts", "seq", "score", "confidence")


def state_changes(states: DataFrame, col: str = "state", piece_rows: int | None = None,
                  profile: Profile | None = None) -> DataFrame:
    """Rows on which ``col`` differs from the row before, the first row included."""
    lay = arrange(states, before=1, piece_rows=piece_rows, profile=profile)
    df = lay.df.withColumn("_prev", F.lag(col).over(lay.ordered()))
    return lay.done(df).where(~F.col("_prev").eqNullSafe(F.col(col))).drop("_prev")


def inactivity_alerts(states: DataFrame, hours: float = 4.0, from_hour: int = 8, to_hour: int = 22,
                      piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """Idle spells of at least ``hours``, where the moment they reach it lies in the given hours of the day."""
    changes = state_changes(states.select("device_id", "ts", "seq", "state"), piece_rows=piece_rows, profile=profile)
    lay = arrange(changes, after=1, piece_rows=piece_rows, profile=profile and profile.of_subset())
    runs = lay.done(lay.df.withColumn("_next", F.lead("ts").over(lay.ordered())))
    ends = states.groupBy("device_id").agg(F.max("ts").alias("_end"))
    us = int(hours * 3600 * 1_000_000)
    idle = (
        runs.where(F.col("state") == "IDLE").join(ends, "device_id")
        .withColumn("idle_until", F.coalesce("_next", "_end"))
        .withColumn("alert_ts", F.timestamp_micros(F.unix_micros("ts") + us))
    )
    hour = F.hour("alert_ts")
    return idle.where((F.col("idle_until") >= F.col("alert_ts")) & (hour >= from_hour) & (hour < to_hour)).select(
        "device_id", F.col("ts").alias("idle_since"), "alert_ts",
        ((F.unix_micros("idle_until") - F.unix_micros("ts")) / 3.6e9).alias("idle_hours"))


def detection_events(rows: DataFrame) -> DataFrame:
    """One JSON event per row."""
    return rows.select("device_id", F.to_json(F.struct(
        F.col("score").alias("movement"), "confidence", "state",
        F.unix_seconds("ts").alias("timestamp"))).alias("value"))


def response(message: Column) -> Column:
    """JSON messages as they are, plain text wrapped."""
    return F.when(F.try_parse_json(message).isNotNull(), message).otherwise(
        F.to_json(F.struct(message.alias("response"))))
