"""Score packets and debounce the score into motion states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import scalar as S
from rfsense.operators.layout import Profile, arrange
from rfsense.operators.scan import debounce_machine, gate_machine, scan


def default_scores(feats: DataFrame) -> DataFrame:
    return feats.withColumn("score", S.default_score())


def wide_model(model: DataFrame) -> DataFrame:
    """One row per device with weight and range columns of every feature."""
    cols = []
    for i in range(len(K.FEATURES)):
        hit = F.col("feature_idx") == i
        cols += [F.max(F.when(hit, F.col("weight"))).alias(f"_w{i}"),
                 F.max(F.when(hit, F.col("feat_min"))).alias(f"_lo{i}"),
                 F.max(F.when(hit, F.col("feat_max"))).alias(f"_hi{i}")]
    return model.groupBy("device_id").agg(*cols)


def scores(feats: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Calibrated score where the device has a model, default score elsewhere; ``mode`` says which."""
    if model is None:
        return default_scores(feats).withColumn("mode", F.lit("default"))
    return scores_by(feats, wide_model(model))


def scores_by(feats: DataFrame, wide: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``scores`` by a model of one row per device; the columns ``more`` of that row come along."""
    wide = wide.withColumn("_has", F.lit(True))
    terms = F.lit(0.0)
    for i, name in enumerate(K.FEATURES):
        term = F.col(f"_w{i}") * S.normalise(F.col(name), F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        terms = terms + F.coalesce(term, F.lit(0.0))
    joined = feats.join(wide, "device_id", "left")
    has = F.col("_has").isNotNull()
    return (
        joined.withColumn("score", F.when(has, terms).otherwise(S.default_score()))
        .withColumn("mode", F.when(has, "calibrated").otherwise("default"))
        .select(*feats.columns, *more, "score", "mode")
    )


def detect(scored: DataFrame, threshold: Column | float, debounce: int = 10, persistence: int = 3,
           keep: tuple[str, ...] = (), piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """State and confidence per row; ``persistence`` in seconds from the detection's start."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    df = (
        scored.select("device_id", "ts", "seq", "score", thr.alias("threshold"), *keep)
        .withColumn("above", F.col("score") > F.col("threshold"))
        .withColumn("_sec", F.unix_seconds("ts"))
    )
    out = scan(arrange(df, piece_rows=piece_rows, profile=profile), debounce_machine(debounce, persistence),
               ("score", "threshold", *keep))
    return out.withColumn("confidence", S.confidence(
        F.col("score"), F.col("threshold"), F.col("downgraded"))).drop("downgraded")


def gate(states: DataFrame, delta: float = K.PUBLISH_DELTA, heartbeat_ms: int = K.PUBLISH_HEARTBEAT_MS,
         enabled: bool = True, order: tuple[str, ...] = ("ts", "seq"), keep: tuple[str, ...] = (),
         piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """Flag the rows to publish: first, changed state, moved score, or heartbeat."""
    if not enabled:
        return states.withColumn("published", F.lit(True))
    df = states.withColumn("_ms", F.unix_millis("ts"))
    return scan(arrange(df, order=order, piece_rows=piece_rows, profile=profile), gate_machine(delta, heartbeat_ms),
                ("state", "score", *keep))

