"""Scalar maths on columns: normalisation, confidence, thresholding, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rfsense import constants as K


def _c(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def normalise(v: Column, lo: Column | float, hi: Column | float) -> Column:
    """(v - lo)/(hi - lo) clamped to [0, 1]; 0 for a (near) empty range."""
    lo, hi = _c(lo), _c(hi)
    rng = hi - lo
    return F.when(rng < K.EPS, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / rng)))


def default_score(weights: tuple[float, ...] = K.DEFAULT_WEIGHTS,
                  ranges: tuple[tuple[float, float], ...] = K.DEFAULT_RANGES) -> Column:
    """Weighted sum of the normalised features; zero weights are left out, so their features are pruned."""
    s: Column | None = None
    for name, w, (lo, hi) in zip(K.FEATURES, weights, ranges, strict=True):
        if w:
            term = F.lit(w) * normalise(F.col(name), lo, hi)
            s = term if s is None else s + term
    return F.lit(0.0) if s is None else s


def confidence(score: Column, threshold: Column, downgraded: Column | None = None) -> Column:
    c = F.when(threshold > K.EPS, F.least(F.lit(1.0), score / (threshold + K.EPS))).otherwise(
        F.when(score > 0, 1.0).otherwise(0.0))
    return c if downgraded is None else F.when(downgraded, 0.0).otherwise(c)


def soft_threshold(v: Column, t: Column | float) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - _c(t), F.lit(0.0))


def hard_threshold(v: Column, t: Column | float) -> Column:
    return F.when(F.abs(v) > _c(t), v).otherwise(0.0)


def separation_quality(ratio: Column) -> Column:
    return (F.when(ratio >= 2.5, "excellent").when(ratio >= 2.0, "good")
            .when(ratio >= 1.5, "fair").otherwise("poor"))


def separation_warnings(ratio: Column) -> Column:
    # Fixed value: the warning text.
    text = F.format_string(
        "Low separation ratio (%.2f < 2.0) - consider more intense movement", ratio)
    return F.when(ratio < 2.0, F.array(text)).otherwise(F.array().cast("array<string>"))


def decode(code: Column, names: Mapping[int, str]) -> Column:
    """Code to name, UNKNOWN for a code without one."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("UNKNOWN"))


STATE_NAMES = {0: "IDLE", 1: "DETECTED"}
PHASE_NAMES = {0: "IDLE", 1: "BASELINE", 2: "MOVEMENT", 3: "ANALYZING"}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def median_sorted(s: Column) -> Column:
    """Median of a sorted array, mean of the middle two for even length."""
    n = F.size(s)
    hi = F.get(s, F.floor(n / 2).cast("int"))
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    return F.when(n % 2 == 1, hi).otherwise((lo + hi) / 2)


def noise_sigma(coeffs: Column) -> Column:
    """median(|c|)/0.6745 of an array, 1.0 when empty."""
    s = F.sort_array(F.transform(coeffs, lambda c: F.abs(c)))
    return F.when(F.size(s) == 0, 1.0).otherwise(median_sorted(s) / 0.6745)


def noise_sigma_of(value: Column) -> Column:
    """The same as an aggregate over rows: it holds counts of distinct values, never an array of all rows."""
    return F.coalesce(F.percentile(F.abs(value), 0.5) / 0.6745, F.lit(1.0))


def round_exactly(x: Column, digits: int) -> Column:
    """A number from 0 to 2^40 rounded by its exact binary value, ties to even, as C prints it; the engine's own rounding goes by the shortest decimal."""
    ten = float(10**digits)
    low = F.floor(x * ten).cast("double")
    # Twice the exact distance from the middle: the two halves of x have few bits, so their products are exact.
    c = x * 134217729.0
    high = c - (c - x)
    over = (high * (2.0 * ten) - (low * 2.0 + 1.0)) + (x - high) * (2.0 * ten)
    up = (over > 0) | (over == 0) & (low % 2 == 1)
    return (low + F.when(up, 1.0).otherwise(0.0)) / ten
