"""Per-packet features as expressions over the I/Q array column.

Packet values are small integers, so all sums stay exact in BIGINT; doubles appear
only in the final division or root.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rfsense import constants as K


def _n(x: Column) -> Column:
    return F.size(x).cast("long")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def total_sq(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v * v)


def total_prod(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def pop_variance(x: Column) -> Column:
    """Population variance of an integer array, 0 when empty."""
    n, s, q = _n(x), total(x), total_sq(x)
    return F.when(n == 0, 0.0).otherwise((n * q - s * s).cast("double") / (n * n))


def mean(x: Column) -> Column:
    n = _n(x)
    return F.when(n == 0, 0.0).otherwise(total(x).cast("double") / n)


def admitted(iq: Column) -> Column:
    """Long enough to be a packet."""
    return F.size(iq) >= K.MIN_PACKET_VALUES


def select_subcarriers(iq: Column, start: int = K.SUBCARRIER_RANGE[0],
                       end: int = K.SUBCARRIER_RANGE[1]) -> Column:
    """Values of subcarriers [start, end) where the packet has more than ``end`` of them, else all."""
    x = iq.cast("array<int>")
    return F.when(F.size(x) >= 2 * (end + 1),
                  F.slice(x, 2 * start + 1, 2 * (end - start))).otherwise(x)


def analysis_band(iq: Column) -> Column:
    lo, hi = K.ANALYSIS_BAND
    return F.slice(iq.cast("array<int>"), lo + 1, hi - lo)


def amplitudes(x: Column) -> Column:
    """sqrt(I^2 + Q^2) of each I/Q pair."""
    pairs = F.floor(F.size(x) / 2).cast("int")
    even = F.filter(x, lambda v, i: i % 2 == 0)
    odd = F.filter(x, lambda v, i: i % 2 == 1)
    amp = F.zip_with(even, odd, lambda a, b: F.sqrt((a * a + b * b).cast("double")))
    return F.slice(amp, 1, pairs)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(
        F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def array_stddev_pop(a: Column) -> Column:
    """Population standard deviation of a double array in one pass, 0 when empty."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1.0
        m = s["m"] + (v - s["m"]) / n
        return F.struct(n.alias("n"), m.alias("m"), (s["q"] + (v - s["m"]) * (v - m)).alias("q"))

    return F.aggregate(a, zero, step, lambda s: F.when(s["n"] == 0, 0.0).otherwise(F.sqrt(s["q"] / s["n"])))


def entropy(x: Column) -> Column:
    """Shannon entropy in bits of the value histogram, as log2(n) - sum(c*log2(c))/n over runs of sorted values."""
    n = _n(x)

    def clog(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c)).otherwise(0.0)

    def step(m: Column, v: Column) -> Column:
        same = m["v"].eqNullSafe(v)
        return F.struct(
            v.cast("int").alias("v"),
            F.when(same, m["c"] + 1.0).otherwise(1.0).alias("c"),
            F.when(same, m["h"]).otherwise(m["h"] + clog(m["c"])).alias("h"))

    runs = F.aggregate(
        F.sort_array(x),
        F.struct(F.lit(None).cast("int").alias("v"), F.lit(0.0).alias("c"), F.lit(0.0).alias("h")),
        step, lambda m: m["h"] + clog(m["c"]))
    return F.when(n == 0, 0.0).otherwise(F.log2(n) - runs / n)


def iqr(x: Column) -> Column:
    """sorted[3n/4] - sorted[n/4] with integer positions, 0 below four values."""
    n = F.size(x)
    s = F.sort_array(x)
    hi = F.get(s, F.floor(3 * n / 4).cast("int"))
    lo = F.get(s, F.floor(n / 4).cast("int"))
    return F.when(n < 4, 0.0).otherwise((hi - lo).cast("double"))


def adjacent_diffs(x: Column) -> Column:
    """Absolute differences of neighbouring values; empty below two values."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, 2, n), F.slice(x, 1, n), lambda a, b: F.abs(a - b))


def spatial_correlation(x: Column) -> Column:
    """Pearson correlation of neighbouring values, 0 for a (near) zero denominator."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    a, b = F.slice(x, 1, n), F.slice(x, 2, n)
    sa, sb = total(a), total(b)
    num = (n * total_prod(a, b) - sa * sb).cast("double")
    ta = (n * total_sq(a) - sa * sa).cast("double")
    tb = (n * total_sq(b) - sb * sb).cast("double")
    den = F.sqrt(F.greatest(ta, F.lit(0.0)) * F.greatest(tb, F.lit(0.0)))
    return F.when((F.size(x) < 2) | (den < K.EPS), 0.0).otherwise(num / den)


def abs_delta(x: Column, prev: Column) -> Column:
    """Element-wise absolute change against the previous packet, null when there is none of equal length."""
    return F.when(prev.isNotNull() & (F.size(x) == F.size(prev)),
                  F.zip_with(x, prev, lambda a, b: F.abs(a - b)))


def packet_columns(x: Column, diffs: Column) -> dict[str, Column]:
    """Feature name -> expression over the selected values and their neighbour differences."""
    return {
        "variance": pop_variance(x),
        "entropy": entropy(x),
        "iqr": iqr(x),
        "spatial_variance": pop_variance(diffs),
        "spatial_correlation": spatial_correlation(x),
        "spatial_gradient": mean(diffs),
    }
