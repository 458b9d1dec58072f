"""Packet features over Arrow batches.

Array expressions cost tens of microseconds per packet and feature in the JVM, because
higher-order functions are interpreted element by element. These functions take a whole
batch of packets as one integer matrix instead. They give the same values as the column
expressions in ``packet``; sums of the small integers are exact in both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rfsense import constants as K


class Rows:
    """Packets of one length as a matrix, with the intermediate results features share."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.m, self.n = x.shape

    @cached_property
    def ordered(self) -> np.ndarray:
        return np.sort(self.x, axis=1)

    @cached_property
    def diffs(self) -> np.ndarray:
        return np.abs(np.diff(self.x, axis=1))

    @cached_property
    def amplitudes(self) -> np.ndarray:
        pairs = self.x[:, : self.n // 2 * 2]
        return np.sqrt((pairs[:, 0::2] ** 2 + pairs[:, 1::2] ** 2).astype(float))


def _zeros(r: Rows) -> np.ndarray:
    return np.zeros(r.m)


def _int_mean(v: np.ndarray) -> np.ndarray:
    return v.sum(axis=1) / v.shape[1] if v.shape[1] else np.zeros(len(v))


def _int_variance(v: np.ndarray) -> np.ndarray:
    n = v.shape[1]
    if n == 0:
        return np.zeros(len(v))
    s = v.sum(axis=1)
    return (n * (v * v).sum(axis=1) - s * s) / float(n * n)


def _entropy(r: Rows) -> np.ndarray:
    if r.n == 0:
        return _zeros(r)
    s = r.ordered
    starts = np.ones(s.shape, dtype=bool)
    starts[:, 1:] = s[:, 1:] != s[:, :-1]
    at = np.flatnonzero(starts)
    runs = np.diff(np.append(at, s.size)).astype(float)
    return np.log2(r.n) - np.bincount(at // r.n, runs * np.log2(runs), r.m) / r.n


def _iqr(r: Rows) -> np.ndarray:
    if r.n < 4:
        return _zeros(r)
    return (r.ordered[:, 3 * r.n // 4] - r.ordered[:, r.n // 4]).astype(float)


def _correlation(r: Rows) -> np.ndarray:
    if r.n < 2:
        return _zeros(r)
    a, b, n = r.x[:, :-1], r.x[:, 1:], r.n - 1
    sa, sb = a.sum(axis=1), b.sum(axis=1)
    num = n * (a * b).sum(axis=1) - sa * sb
    den = np.sqrt((n * (a * a).sum(axis=1) - sa * sa).astype(float) * (n * (b * b).sum(axis=1) - sb * sb))
    return np.where(den < K.EPS, 0.0, num / np.where(den < K.EPS, 1.0, den))


def _mean_amplitude(r: Rows) -> np.ndarray:
    return r.amplitudes.mean(axis=1) if r.n > 1 else _zeros(r)


def _turbulence(r: Rows) -> np.ndarray:
    return r.amplitudes.std(axis=1) if r.n > 1 else _zeros(r)


FEATURES: dict[str, Callable[[Rows], np.ndarray]] = {
    "variance": lambda r: _int_variance(r.x),
    "entropy": _entropy,
    "iqr": _iqr,
    "spatial_variance": lambda r: _int_variance(r.diffs),
    "spatial_correlation": _correlation,
    "spatial_gradient": lambda r: _int_mean(r.diffs),
    "mean_amplitude": _mean_amplitude,
    "turbulence": _turbulence,
}


def _lengths(a: pa.Array) -> np.ndarray:
    return a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)


def _matrices(a: pa.Array, lengths: np.ndarray, dtype: type = np.int64):
    """(row numbers, matrix) for every length that occurs."""
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    kinds = np.unique(lengths[lengths >= 0])
    if len(kinds) == 1 and (lengths >= 0).all():
        yield np.arange(len(lengths)), flat.reshape(len(lengths), kinds[0])
        return
    sizes = np.maximum(lengths, 0)
    first = np.cumsum(sizes) - sizes
    for k in kinds:
        rows = np.flatnonzero(lengths == k)
        yield rows, flat[first[rows][:, None] + np.arange(k)]


def feature_struct(x: Column, names: Iterable[str]) -> Column:
    """The named features of an integer array column as one struct."""
    names = list(names)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def batch(a: pa.Array) -> pa.Array:
        lengths = _lengths(a)
        out = {n: np.zeros(len(a)) for n in names}
        for rows, m in _matrices(a, lengths):
            r = Rows(m)
            for n in names:
                out[n][rows] = FEATURES[n](r)
        return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], names=names)

    return batch(x)


def amplitude_array(x: Column) -> Column:
    """Amplitude of every I/Q pair."""

    @F.arrow_udf("array<double>")
    def batch(a: pa.Array) -> pa.Array:
        lengths = _lengths(a)
        pairs = np.maximum(lengths, 0) // 2
        ends = np.cumsum(pairs)
        flat = np.zeros(ends[-1] if len(ends) else 0)
        for rows, m in _matrices(a, lengths):
            k = m.shape[1] // 2
            flat[(ends[rows] - k)[:, None] + np.arange(k)] = Rows(m).amplitudes
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(flat))

    return batch(x)


def delta_struct(x: Column, prev: Column) -> Column:
    """Mean and variance of the absolute change between two array columns; 0 without a previous packet."""

    @F.arrow_udf("struct<temporal_delta_mean: double, temporal_delta_variance: double>")
    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        la, lb = _lengths(a), _lengths(b)
        mean, var = np.zeros(len(a)), np.zeros(len(a))
        before = {}
        for rows, m in _matrices(b, lb):
            before[m.shape[1]] = (rows, m)
        for rows, m in _matrices(a, la):
            if m.shape[1] not in before:
                continue
            prev_rows, p = before[m.shape[1]]
            both, i, j = np.intersect1d(rows, prev_rows, assume_unique=True, return_indices=True)
            d = np.abs(m[i] - p[j])
            mean[both], var[both] = _int_mean(d), _int_variance(d)
        return pa.StructArray.from_arrays([pa.array(mean), pa.array(var)],
                                          names=["temporal_delta_mean", "temporal_delta_variance"])

    return batch(x, prev)


def moment_struct(frame: Column) -> Column:
    """Skewness and excess kurtosis of a frame of values; 0 for short or flat frames."""

    @F.arrow_udf("struct<skewness: double, kurtosis: double>")
    def batch(a: pa.Array) -> pa.Array:
        skew, kurt = np.zeros(len(a)), np.zeros(len(a))
        for rows, w in _matrices(a, _lengths(a), float):
            n = w.shape[1]
            if n < 3:
                continue
            d = w - w.mean(axis=1, keepdims=True)
            d2 = d * d
            m2 = d2.mean(axis=1)
            s = np.sqrt(m2)
            flat = s < K.EPS
            skew[rows] = np.where(flat, 0.0, (d2 * d).mean(axis=1) / np.where(flat, 1.0, s * s * s))
            if n >= 4:
                flat = m2 < K.EPS
                kurt[rows] = np.where(flat, 0.0, (d2 * d2).mean(axis=1) / np.where(flat, 1.0, m2 * m2) - 3.0)
        return pa.StructArray.from_arrays([pa.array(skew), pa.array(kurt)], names=["skewness", "kurtosis"])

    return batch(frame)
