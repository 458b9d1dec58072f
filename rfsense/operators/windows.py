"""Finite-memory window operators on a scalar column of a layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions.scalar import median_sorted
from rfsense.operators.layout import Layout


def hampel(df: DataFrame, x: str, out: str, lay: Layout, threshold: float = 2.0,
           rows: int = K.HAMPEL_ROWS) -> DataFrame:
    """Median of the last rows where the value lies further than t*1.4826*MAD from it; needs three rows."""
    df = df.withColumn("_win", F.collect_list(x).over(lay.last_n(rows)))
    df = df.withColumn("_med", median_sorted(F.sort_array("_win")))
    df = df.withColumn("_dev", F.sort_array(F.transform("_win", lambda v: F.abs(v - F.col("_med")))))
    far = F.abs(F.col(x) - F.col("_med")) > threshold * (K.MAD_SCALE * median_sorted(F.col("_dev")))
    value = F.when((F.size("_win") >= 3) & far, F.col("_med")).otherwise(F.col(x))
    return df.withColumn(out, value).drop("_win", "_med", "_dev")


def savgol(older: Column, newest: Column, lay: Layout) -> Column:
    """Five-point smoothing of the trailing rows; the newest term may come from an earlier filter stage."""
    o = lay.ordered()
    terms = [K.SAVGOL[i] * F.lag(older, 4 - i).over(o) for i in range(4)]
    s = terms[0]
    for t in terms[1:]:
        s = s + t
    full = F.count(older).over(lay.last_n(5)) == 5
    return F.when(full, s + K.SAVGOL[4] * newest).otherwise(newest)


def savgol_or_mean(x: Column, lay: Layout) -> Column:
    """Standalone form: a shorter frame gives its plain mean."""
    w = lay.last_n(5)
    return F.when(F.count(x).over(w) == 5, savgol(x, x, lay)).otherwise(F.avg(x).over(w))


def moving_variance(x: Column, lay: Layout, rows: int, pos: Column) -> Column:
    """Population variance of the last ``rows``; 0 until the frame is full."""
    return F.when(pos >= rows - 1, F.var_pop(x).over(lay.last_n(rows))).otherwise(0.0)


def rolling_stats(x: Column, lay: Layout, rows: int = K.STATS_ROWS) -> dict[str, Column]:
    w = lay.last_n(rows)
    return {
        "min": F.min(x).over(w), "max": F.max(x).over(w), "mean": F.avg(x).over(w),
        "stddev": F.stddev_pop(x).over(w), "count": F.count(x).over(w),
    }


def sorted_frame(x: Column, lay: Layout, rows: int = K.STATS_ROWS) -> Column:
    return F.sort_array(F.collect_list(x).over(lay.last_n(rows)))


def percentile_lower(frame: Column, p: float) -> Column:
    """sorted[floor(p/100*(n-1))]."""
    return F.get(frame, F.floor(F.lit(p / 100.0) * (F.size(frame) - 1)).cast("int"))


def recommended_threshold(frame: Column) -> Column:
    """(p50 + p75)/2 from at least 50 samples, else 0."""
    return F.when(F.size(frame) >= 50,
                  (percentile_lower(frame, 50) + percentile_lower(frame, 75)) / 2).otherwise(0.0)
