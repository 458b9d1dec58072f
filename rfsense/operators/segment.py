"""Motion segmentation, segment features, and the studies built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import kernels as Q
from rfsense.functions import packet as P
from rfsense.operators import windows as W
from rfsense.operators.layout import Layout, arrange
from rfsense.operators.scan import scan, segment_machine

SIGNAL = ("device_id", "phase")
SEGMENT_FEATURES = ("variance", "std", "mean", "max", "min", "range", "iqr", "median", "duration")


def turbulence(packets: DataFrame) -> DataFrame:
    """Spatial turbulence: spread of the amplitudes in the analysis band."""
    f = Q.feature_struct(P.analysis_band(F.col("iq")), ["turbulence"])
    return packets.select("device_id", "phase", "ts", "seq", f["turbulence"].alias("turbulence"))


def _moving(signal: DataFrame, x: str, windows: tuple[int, ...], keys: tuple[str, ...],
            piece_rows: int | None) -> Layout:
    """Layout whose frame has _pos and the moving variance mv_<w> for every window."""
    lay = arrange(signal, before=max(windows) - 1, keys=keys, piece_rows=piece_rows)
    df = lay.df.withColumn("_pos", lay.pos())
    full = F.col("_pos")
    for w in windows:
        df = df.withColumn(f"mv_{w}", W.moving_variance(F.col(x), lay, w, full))
    # A signal shorter than the window has no variance at all, which the zeros already say.
    return lay.with_df(df)


def baseline_levels(lay: Layout, windows: tuple[int, ...]) -> DataFrame:
    """Mean and spread of the full-frame moving variance of each device's baseline, per window."""
    base = lay.done(lay.df).where(F.col("phase") == "BASELINE")
    cols = []
    for w in windows:
        v = F.when(F.col("_pos") >= w - 1, F.col(f"mv_{w}"))
        cols += [F.avg(v).alias(f"mean_{w}"), F.stddev_pop(v).alias(f"std_{w}")]
    return base.groupBy("device_id").agg(*cols)


def adaptive_threshold(signal: DataFrame, x: str = "turbulence", window: int = 20, k: float = 2.5,
                       piece_rows: int | None = None) -> DataFrame:
    """mean + k*std of the valid baseline moving variance."""
    lay = _moving(signal.where(F.col("phase") == "BASELINE"), x, (window,), SIGNAL, piece_rows)
    m, s = F.col(f"mean_{window}"), F.col(f"std_{window}")
    return baseline_levels(lay, (window,)).select(
        "device_id", m.alias("mean_variance"), s.alias("std_variance"), (m + k * s).alias("threshold"))


def segments(signal: DataFrame, thresholds: DataFrame, x: str = "turbulence", window: int = 20,
             shortest: int = 10, longest: int = 60, keys: tuple[str, ...] = SIGNAL,
             piece_rows: int | None = None) -> DataFrame:
    """Motion segments (start_pos, length) of every signal against its device's threshold."""
    lay = _moving(signal, x, (window,), keys, piece_rows)
    lay = lay.with_df(lay.df.join(lay.per_key(thresholds.select("device_id", "threshold")), "device_id"))
    m = segment_machine([(0, f"mv_{window}", "threshold", longest)])
    return scan(lay, m, explode=True).where(F.col("length") >= shortest).drop("config")


def segment_features(signal: DataFrame, segs: DataFrame, x: str = "turbulence", rate: float = 20.0,
                     keys: tuple[str, ...] = SIGNAL, longest: int = 60, piece_rows: int | None = None) -> DataFrame:
    """Nine features of every segment plus its start time.

    Rows and segments meet on position blocks of one segment length, so the join is an
    equality join that spreads a hot device over its blocks.
    """
    lay = arrange(signal, keys=keys, piece_rows=piece_rows)
    rows = lay.done(lay.df.withColumn("_pos", lay.pos())).select(*keys, "_pos", x)
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / longest))
    last = F.col("start_pos") + F.col("length") - 1
    spread = segs.withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("start_pos") / longest), F.floor(last / longest))))
    inside = (F.col("_pos") >= F.col("start_pos")) & (F.col("_pos") <= last)
    v = F.col(x)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        rows.join(spread, [*keys, "_block"]).where(inside)
        .groupBy(*keys, "start_pos", "length")
        .agg(F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std"), F.avg(v).alias("mean"),
             F.max(v).alias("max"), F.min(v).alias("min"), q.alias("_q"))
        .select(*keys, "start_pos", "length", "variance", "std", "mean", "max", "min",
                (F.col("max") - F.col("min")).alias("range"),
                (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), F.col("_q")[1].alias("median"),
                (F.col("length") / rate).alias("duration"), (F.col("start_pos") / rate).alias("start_time"))
    )


def count_rule(signal: DataFrame, segs: DataFrame) -> DataFrame:
    """A baseline without segments and a movement with some are right; accuracy is their mean in percent."""
    devices = signal.select("device_id").distinct()
    n = segs.groupBy("device_id").agg(
        F.count_if(F.col("phase") == "BASELINE").alias("baseline_segments"),
        F.count_if(F.col("phase") == "MOVEMENT").alias("movement_segments"))
    b, m = F.col("baseline_segments"), F.col("movement_segments")
    return (
        devices.join(n, "device_id", "left").fillna(0, ["baseline_segments", "movement_segments"])
        .withColumn("baseline_correct", b == 0).withColumn("movement_correct", m > 0)
        .withColumn("accuracy", (F.col("baseline_correct").cast("int") + F.col("movement_correct").cast("int")) * 50.0)
    )


def grid_score(tp: Column, fp: Column) -> Column:
    miss = F.when(tp > 0, F.abs(tp - 5)).otherwise(10)
    return F.least(tp, F.lit(7)) - fp * 10 - miss * 0.5


def grid_search(signal: DataFrame, x: str = "turbulence", ks: tuple[float, ...] = K.GRID_K,
                windows: tuple[int, ...] = K.GRID_WINDOW, shortest: tuple[int, ...] = K.GRID_MIN,
                longest: tuple[int, ...] = K.GRID_MAX, piece_rows: int | None = None) -> DataFrame:
    """Segment counts and score of every parameter combination, per device.

    The moving variances are computed once per window, and one walk over the rows serves all
    thresholds and caps; the minimum lengths only filter its segments.
    """
    lay = _moving(signal, x, windows, SIGNAL, piece_rows)
    levels = baseline_levels(lay, windows)
    thr = [(F.col(f"mean_{w}") + k * F.col(f"std_{w}")).alias(f"thr_{i}_{w}")
           for i, k in enumerate(ks) for w in windows]
    joined = lay.df.join(lay.per_key(levels.select("device_id", *thr)), "device_id")
    configs, minima, combos = [], {}, []
    for i, k in enumerate(ks):
        for w in windows:
            for mx in longest:
                cid = len(configs)
                configs.append((cid, f"mv_{w}", f"thr_{i}_{w}", mx))
                minima[cid] = list(shortest)
    order = 0
    ids = {(c[1], c[2], c[3]): c[0] for c in configs}
    for i, k in enumerate(ks):
        for w in windows:
            for mn in shortest:
                for mx in longest:
                    combos.append((ids[(f"mv_{w}", f"thr_{i}_{w}", mx)], mn, order, float(k), w, mx))
                    order += 1
    counts = scan(lay.with_df(joined), segment_machine(configs, minima), explode=True)
    totals = counts.groupBy("device_id", "config", "min_length").agg(
        F.sum(F.when(F.col("phase") == "BASELINE", F.col("segments")).otherwise(0)).alias("false_positives"),
        F.sum(F.when(F.col("phase") == "MOVEMENT", F.col("segments")).otherwise(0)).alias("true_positives"))
    grid = signal.sparkSession.createDataFrame(
        combos, "config bigint, min_length bigint, combo int, k double, window int, max_length int")
    # The grid is a fixed few hundred rows.
    return totals.join(F.broadcast(grid), ["config", "min_length"]).select(
        "device_id", "combo", "k", "window", F.col("min_length").cast("int").alias("min_length"), "max_length",
        "false_positives", "true_positives",
        grid_score(F.col("true_positives"), F.col("false_positives")).cast("double").alias("score"))


def top_configs(results: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` combinations of a device by score, ties in grid order; best marks a usable first."""
    w = Window.partitionBy("device_id").orderBy(F.desc("score"), "combo")
    return (results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumn("best", (F.col("rank") == 1) & (F.col("score") > -1)))
