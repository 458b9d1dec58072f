"""Linear recurrences: order-4 low-pass and EWMA normaliser.

Both forget: the low-pass impulse response and the EWMA weights fall below 2^-60 of a
unit after a known number of rows. A piece of a hot device therefore starts that many
rows early and needs nothing else from the rows before it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.operators.layout import PIECE_ROWS, Layout, Profile, arrange, measure
from rfsense.operators.walk import Columns, walk

LOWPASS_ROWS = 192


def impulse_response(n: int = LOWPASS_ROWS, b: tuple[float, ...] = K.LOWPASS_B,
                     a: tuple[float, ...] = K.LOWPASS_A) -> np.ndarray:
    h = np.zeros(n)
    for i in range(n):
        h[i] = (b[i] if i < len(b) else 0.0) - sum(a[j] * h[i - j] for j in range(1, min(i, len(a) - 1) + 1))
    return h


def ewma_rows(alpha: float) -> int:
    """Rows after which the weight of the starting state is below 2^-60."""
    return math.ceil(60 * math.log(2) / -math.log1p(-alpha))


BLOCK = 256


@lru_cache(maxsize=16)
def _smoothing_block(alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a block's own samples, and of the value before the block."""
    decay = (1.0 - alpha) ** np.arange(BLOCK + 1)
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    return np.where(lag >= 0, alpha * decay[np.abs(lag)], 0.0), decay[1:]


def smooth(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """y[t] = (1-alpha)*y[t-1] + alpha*x[t] from y[-1] = start, a block at a time."""
    own, before = _smoothing_block(alpha)
    out = np.empty(len(x))
    for lo in range(0, len(x), BLOCK):
        b = x[lo:lo + BLOCK]
        k = len(b)
        out[lo:lo + k] = own[:k, :k] @ b + before[:k] * start
        start = out[lo + k - 1]
    return out


def ewma_mean_var(x: np.ndarray, alpha: float, before: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Running mean and variance of the normaliser, going on from ``before`` or from the first sample and 1.0."""
    m0, v0 = before or (float(x[0]), 1.0)
    m = smooth(x, alpha, m0)
    # v' = (1-a)*(v + a*d^2) with d = x - previous mean: the same smoothing, fed (1-a)*d^2.
    feed = (1.0 - alpha) * (x - np.concatenate([[m0], m[:-1]])) ** 2
    if before is None:
        feed[0] = 1.0
    return m, smooth(feed, alpha, v0)


def _apply(lay: Layout, x: str, fn, extra: str) -> DataFrame:
    """Keys, order columns and ``x`` as they are, next to the columns ``fn(values, state)`` gives."""
    cols = list(dict.fromkeys([*lay.keys, *lay.order, x]))
    types = dict(lay.df.dtypes)
    pieces = lay.pieces

    def step(c: Columns, state) -> tuple[Columns, object]:
        new, state = fn(np.asarray(c[x], dtype=float), state)
        out = {**{k: c[k] for k in cols}, **new}
        if pieces:
            core = np.asarray(c["_core"], dtype=bool)
            out = {k: v[core] for k, v in out.items()}
        return out, state

    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", " + extra
    return walk(lay.df, lay.part, lay.order, [*cols, *(["_core"] if pieces else [])], step, schema)


def lowpass(df: DataFrame, x: str, out: str = "lowpass", piece_rows: int | None = None, **layout) -> DataFrame:
    """Order-4 IIR low-pass from zero state, as its impulse response."""
    lay = arrange(df, before=LOWPASS_ROWS, piece_rows=piece_rows, **layout)
    h = impulse_response()

    def fn(v: np.ndarray, past: np.ndarray | None):
        past = np.zeros(0) if past is None else past
        seen = np.concatenate([past, v])
        return {out: np.convolve(seen, h)[len(past):len(seen)]}, seen[-(LOWPASS_ROWS - 1):]

    return _apply(lay, x, fn, f"`{out}` double")


def ewma(df: DataFrame, x: str, alpha: float = 0.02, piece_rows: int | None = None, **layout) -> DataFrame:
    """EWMA mean, variance and standard deviation next to the untouched signal."""
    lay = arrange(df, before=ewma_rows(alpha), piece_rows=piece_rows, **layout)

    def fn(v: np.ndarray, before: tuple[float, float] | None):
        m, var = ewma_mean_var(v, alpha, before)
        return {"ewma_mean": m, "ewma_variance": var, "ewma_stddev": np.sqrt(var)}, (float(m[-1]), float(var[-1]))

    return _apply(lay, x, fn, "ewma_mean double, ewma_variance double, ewma_stddev double")


def ewma_with_resets(df: DataFrame, x: str, epoch: str, alpha: float = 0.02,
                     piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """EWMA started anew in every epoch of a device."""
    return ewma(df, x, alpha, piece_rows, keys=("device_id", epoch), profile=profile)


def cascade(df: DataFrame, x: str, hampel_threshold: float = 2.0, alpha: float = 0.02,
            lowpass_on: bool = True, wavelet_on: bool = False, hampel_on: bool = True,
            savgol_on: bool = True, normalise_on: bool = True, wavelet_level: int = 2,
            wavelet_threshold: float = 1.0, piece_rows: int | None = None) -> DataFrame:
    """Low-pass, wavelet, Hampel, Savitzky-Golay, then EWMA of the result as a side output."""
    from rfsense.operators import wavelet as V
    from rfsense.operators import windows as W

    cur = df.select("device_id", "ts", "seq", x)
    piece_rows = max(piece_rows or PIECE_ROWS, ewma_rows(alpha))
    prof = measure(cur, piece_rows=piece_rows)  # every stage keeps the rows
    stage = x
    if lowpass_on:
        cur, stage = lowpass(cur, x, "_lp", piece_rows, profile=prof), "_lp"
    lay = arrange(cur, before=(K.WAVELET_ROWS if wavelet_on else 0) + 8, profile=prof)
    cur = lay.df
    if wavelet_on:
        cur = cur.withColumn("_p", lay.pos())
        cur = cur.withColumn("_wv", V.sliding(F.col(stage), lay, F.col("_p"), wavelet_level, wavelet_threshold))
        stage = "_wv"
    cur = (W.hampel(cur, stage, "_h", lay, hampel_threshold) if hampel_on
           else cur.withColumn("_h", F.col(stage)))
    cur = cur.withColumn("filtered", W.savgol(F.col(stage), F.col("_h"), lay) if savgol_on else F.col("_h"))
    cur = lay.done(cur).select("device_id", "ts", "seq", x, "filtered")
    if not normalise_on:
        return cur
    return ewma(cur, "filtered", alpha, piece_rows, profile=prof)
