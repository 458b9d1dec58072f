"""Packet table to feature table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import kernels as Q
from rfsense.functions import packet as P
from rfsense.operators.layout import Layout, Profile, arrange, measure


def with_previous(df: DataFrame, lay: Layout, x: str = "x", out: str = "prev") -> DataFrame:
    """The last packet of the device whose length equals its first packet's; null for rows of another length."""
    df = lay.first_of(df, F.size(x), "_len")
    same = F.size(x) == F.col("_len")
    df = lay.carry(df, {out: F.when(same, F.col(x))}, inclusive=False)
    return df.withColumn(out, F.when(same, F.col(out))).drop("_len")


def stateless(packets: DataFrame, names: Iterable[str], start: int, end: int, keep: Iterable[str] = ()) -> DataFrame:
    """Selected values ``x``, mean amplitude and the features a packet has by itself; also for streams."""
    own = ["mean_amplitude", *[n for n in names if n in Q.FEATURES]]
    keep = list(keep)
    base = (
        packets.where(P.admitted(F.col("iq")))
        .select("device_id", "seq", "ts", *keep, P.select_subcarriers(F.col("iq"), start, end).alias("x"))
        .withColumn("_f", Q.feature_struct(F.col("x"), own))
    )
    return base.select("device_id", "seq", "ts", *keep, "x", *[F.col(f"_f.{n}").alias(n) for n in own])


def features(
    packets: DataFrame,
    names: Iterable[str] = K.FEATURES,
    start: int = K.SUBCARRIER_RANGE[0],
    end: int = K.SUBCARRIER_RANGE[1],
    keep: Iterable[str] = ("phase",),
    piece_rows: int | None = None,
    profile: Profile | None = None,
) -> DataFrame:
    """The chosen features of every admitted packet, in one pass over the device order.

    Only the moments and the deltas need the order; choosing none of them needs no shuffle.
    """
    names, keep = list(names), list(keep)
    ordered = {"skewness", "kurtosis", "temporal_delta_mean", "temporal_delta_variance"} & set(names)
    base = stateless(packets, names, start, end, keep)
    if ordered:
        if profile is None:  # the packets' keys and times alone; admission reads their values
            profile = measure(packets, piece_rows=piece_rows).of_subset()
        lay = arrange(base, before=K.MOMENT_ROWS - 1, piece_rows=piece_rows, profile=profile)
        base = lay.df
        derived = []
        if ordered & {"skewness", "kurtosis"}:
            base = base.withColumn("_w", F.collect_list("mean_amplitude").over(lay.last_n(K.MOMENT_ROWS)))
            derived.append(Q.moment_struct(F.col("_w")).alias("_m"))
        if ordered & {"temporal_delta_mean", "temporal_delta_variance"}:
            base = with_previous(base, lay)
            derived.append(Q.delta_struct(F.col("x"), F.col("prev")).alias("_d"))
        # One round trip to Python serves both.
        base = base.select("*", *derived)
        base = base.select("*", *[f"{c}.*" for c in ("_m", "_d") if c in base.columns])
        base = lay.done(base)
    return base.select("device_id", "seq", "ts", *keep, *names)


def long_form(feats: DataFrame, keep: Iterable[str], names: Iterable[str] = K.FEATURES) -> DataFrame:
    """One row per feature: feature_idx, feature, value."""
    names = list(names)
    cells = [F.struct(F.lit(i).alias("feature_idx"), F.lit(n).alias("feature"),
                      F.col(n).alias("value")) for i, n in enumerate(names)]
    return feats.select(*keep, F.inline(F.array(*cells)))
