"""Composed jobs: detection, calibration, publishing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import scalar as S
from rfsense.operators import calibrate as C
from rfsense.operators import detect as D
from rfsense.operators import publish as B
from rfsense.operators.features import features, stateless
from rfsense.operators.layout import BROADCAST_ROWS, measure
from rfsense.operators.online import PacketDetector
from rfsense.operators.scan import debounce_machine
from rfsense.operators.walk import walk
from rfsense.session import materialise


def motion_detections(packets: DataFrame, threshold: Column | float = 0.5, debounce: int = 10,
                      persistence: int = 3, model: DataFrame | None = None,
                      piece_rows: int | None = None) -> DataFrame:
    """Packets -> features -> score -> debounced states.

    With the default score, a fixed threshold and no hot device the ordered part is one walk over
    each device's packets, so the job shuffles once. Otherwise features, score and states are
    separate steps, which hot devices can be cut for.
    """
    prof = measure(packets, piece_rows=piece_rows)
    if model is None and not isinstance(threshold, Column) and not prof.hot:
        return _one_walk(packets, float(threshold), debounce, persistence)
    prof = prof.of_subset()  # admission removes rows, which pieces of hot devices would count as look-back
    names = K.FEATURES if model is not None else [n for n, w in zip(K.FEATURES, K.DEFAULT_WEIGHTS) if w]
    feats = features(packets, names, keep=(), piece_rows=piece_rows, profile=prof)
    scored = D.scores(feats, model) if model is not None else feats.withColumn("score", S.default_score())
    return D.detect(scored, threshold, debounce, persistence, piece_rows=piece_rows, profile=prof)


def _one_walk(packets: DataFrame, threshold: float, debounce: int, persistence: int) -> DataFrame:
    detector = PacketDetector(debounce_machine(debounce, persistence), threshold)
    rows = stateless(packets, ("variance", "iqr", "spatial_gradient"), *K.SUBCARRIER_RANGE).withColumn(
        "_sec", F.unix_seconds("ts"))
    kind = dict(rows.dtypes)["device_id"]

    def step(c, state):
        out, state = detector.step(c, detector.start if state is None else state)
        return {**{k: c[k] for k in ("device_id", "ts", "seq")}, **out}, state

    out = walk(rows, ["device_id"], ["ts", "seq"], ["device_id", "ts", "seq", "x", *detector.INPUTS, "_sec"], step,
               f"device_id {kind}, ts timestamp, seq bigint, score double, state string, downgraded boolean")
    thr = F.lit(threshold)
    return out.select("device_id", "ts", "seq", "score", thr.alias("threshold"), "state",
                      S.confidence(F.col("score"), thr, F.col("downgraded")).alias("confidence"))


@dataclass
class Calibration:
    stats: DataFrame
    pairs: DataFrame
    model: DataFrame
    summary: DataFrame


def calibrate(feats: DataFrame, store: bool = True) -> Calibration:
    """Labelled features -> statistics -> selected features, weights, ranges, threshold.

    The statistics, ten rows per device and phase, are written once, so that model, summary and
    what is joined to them do not go back to the packets.
    """
    stats = C.feature_stats(feats)
    if store:
        stats = materialise(stats, "feature-stats")
    pairs = C.paired(stats)
    model = C.model(pairs)
    return Calibration(stats, pairs, model, C.summary(model))


def calibrated_detections(packets: DataFrame, threshold: float = 0.5, debounce: int = 10, persistence: int = 3, piece_rows: int | None = None) -> DataFrame:
    """Labelled packets -> features -> calibration -> states by each device's own model and threshold; ``threshold`` for devices without one.

    The features are computed in one pass and stored, for the calibration and the scoring. Model and threshold, one row per device, come in one join.
    """
    devices = measure(packets, piece_rows=piece_rows)
    prof = devices.of_subset()  # admission removes rows
    feats = materialise(features(packets, piece_rows=piece_rows, profile=prof), "features")
    cal = calibrate(feats)
    own = D.wide_model(cal.model).join(cal.summary.select("device_id", "threshold"), "device_id", "left")
    own = materialise(own, "models")
    small = F.broadcast(own) if devices.n_keys <= BROADCAST_ROWS else own
    scored = D.scores_by(feats, small, ("threshold",))
    return D.detect(scored, F.coalesce(F.col("threshold"), F.lit(float(threshold))), debounce, persistence, piece_rows=piece_rows, profile=prof)


def published(states: DataFrame, period_seconds: int = 1, delta: float = K.PUBLISH_DELTA,
              heartbeat_ms: int = K.PUBLISH_HEARTBEAT_MS, enabled: bool = True,
              times: DataFrame | None = None, piece_rows: int | None = None) -> DataFrame:
    """States -> one row per tick, flagged for publishing.

    ``times`` may name a cheaper frame with the same device_id, ts, seq rows, such as the one the
    states were made from; how the ticks spread is then measured on it.
    """
    times = states if times is None else times
    prof = measure(times, piece_rows=piece_rows)
    t = B.ticks(states, period_seconds, piece_rows=piece_rows, profile=prof)
    tick_prof = B.tick_profile(times, period_seconds, piece_rows, prof)
    return D.gate(t, delta, heartbeat_ms, enabled, order=("ts",), keep=("confidence",),
                  piece_rows=piece_rows, profile=tick_prof)


def normaliser_with_idle_reset(series: DataFrame, threshold: float, debounce: int, persistence: int,
                               timeout: int, alpha: float = 0.02, piece_rows: int | None = None, period_seconds: int = 1) -> DataFrame:
    """Series with score -> states -> idle resets at ticks -> EWMA per span between resets."""
    from rfsense.operators.recurrence import ewma_with_resets
    from rfsense.operators.ticks import idle_resets

    prof = measure(series, piece_rows=piece_rows)
    states = D.detect(series, threshold, debounce, persistence, keep=("x",), piece_rows=piece_rows, profile=prof)
    marked = idle_resets(states, timeout, period_seconds, piece_rows, prof)
    return ewma_with_resets(marked, "x", "epoch", alpha, piece_rows, prof)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for display and comparison."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
