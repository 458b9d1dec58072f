"""Wavelet denoising: circular db4 analysis, detail thresholding, synthesis.

The transform is linear apart from the thresholding, so it is kept as two matrices
and applied to Arrow batches of equal-length arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.operators.layout import Layout, arrange


def matrices(n: int, level: int, mode: str = "adjoint") -> tuple[np.ndarray, np.ndarray]:
    """Analysis (coefficients x samples) and synthesis (samples x coefficients).

    Coefficients run coarsest approximation, coarsest detail, ..., finest detail.
    ``mode``: "adjoint" reconstructs exactly without thresholding, "as_coded" uses the
    separate synthesis taps.
    """
    if n < (1 << level) * 8:
        raise ValueError(f"level {level} needs at least {(1 << level) * 8} samples, got {n}")
    lo_s, hi_s = ((K.DB4_LOW, K.DB4_HIGH) if mode == "adjoint"
                  else (K.DB4_SYN_LOW, K.DB4_SYN_HIGH))
    ana, syn = np.eye(n), np.eye(n)
    size = n
    for _ in range(level):
        a, s = np.eye(n), np.eye(n)
        a[:size, :size] = s[:size, :size] = 0.0
        half = size // 2
        for i in range(half):
            for j in range(8):
                k = (2 * i + j) % size
                a[i, k] += K.DB4_LOW[j]
                a[half + i, k] += K.DB4_HIGH[j]
                s[k, i] += lo_s[j]
                s[k, half + i] += hi_s[j]
        ana, syn = a @ ana, syn @ s
        size = half
    return ana, syn


def denoise_rows(x: np.ndarray, level: int, threshold: float, method: str, mode: str) -> np.ndarray:
    """Denoise each row of a matrix."""
    n = x.shape[1]
    ana, syn = matrices(n, level, mode)
    c = x @ ana.T
    d = c[:, n >> level:]
    if method == "soft":
        d[:] = np.sign(d) * np.maximum(np.abs(d) - threshold, 0.0)
    else:
        d[:] = np.where(np.abs(d) > threshold, d, 0.0)
    return c @ syn.T


def _batch(a: pa.Array, n: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def denoise_array(col: Column, n: int, level: int = 2, threshold: float = 1.0,
                  method: str = "soft", mode: str = "adjoint", at: int | None = None) -> Column:
    """Denoised array of an ``n``-element array column (null stays null), or only its element ``at``."""
    matrices(n, level, mode)

    if at is not None:
        @F.arrow_udf("double")
        def one(a: pa.Array) -> pa.Array:
            valid = a.is_valid().to_numpy(zero_copy_only=False)
            out = np.full(len(a), np.nan)
            if valid.any():
                out[valid] = denoise_rows(_batch(a.drop_null(), n), level, threshold, method, mode)[:, at]
            return pa.array(out, mask=~valid)
        return one(col)

    @F.arrow_udf("array<double>")
    def whole(a: pa.Array) -> pa.Array:
        valid = a.is_valid().to_numpy(zero_copy_only=False)
        y = iter(denoise_rows(_batch(a.drop_null(), n), level, threshold, method, mode)) if valid.any() else iter(())
        return pa.array([next(y) if v else None for v in valid], type=pa.list_(pa.float64()))
    return whole(col)


def sliding(x: Column, lay: Layout, pos: Column, level: int = 2, threshold: float = 1.0,
            method: str = "soft", mode: str = "adjoint", rows: int = K.WAVELET_ROWS) -> Column:
    """Rows 1..``rows`` pass; later rows give the middle of their denoised trailing frame."""
    frame = F.when(pos >= rows, F.collect_list(x).over(lay.last_n(rows)))
    return F.coalesce(denoise_array(frame, rows, level, threshold, method, mode, at=rows // 2), x)


def blocks(df: DataFrame, x: str, n: int = 32, level: int = 2, threshold: float = 1.0,
           method: str = "soft", mode: str = "adjoint", piece_rows: int | None = None,
           **layout) -> DataFrame:
    """Denoise every full block of ``n`` rows of a device: one row per block with its array."""
    lay = arrange(df, piece_rows=piece_rows, **layout)
    numbered = lay.done(lay.df.withColumn("_p", lay.pos()))
    grouped = (
        numbered.groupBy(*lay.keys, F.floor(F.col("_p") / n).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("_p", x))).alias("_b"))
        .where(F.size("_b") == n)
        .withColumn("samples", F.transform("_b", lambda s: s[x]))
    )
    return grouped.select(*lay.keys, "block", denoise_array(
        F.col("samples"), n, level, threshold, method, mode).alias("denoised"))
