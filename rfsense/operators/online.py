"""Packets of one device, in order, a few at a time: moments, deltas, score and state in one step.

Serves the batch walker and the streaming processor, which both keep the returned state.
"""

from __future__ import annotations

import numpy as np

from rfsense import constants as K
from rfsense.operators.scan import Machine
from rfsense.operators.walk import Columns


def windowed_moments(history: np.ndarray, new: np.ndarray, rows: int = K.MOMENT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Skewness and excess kurtosis of the trailing frames ending at each new amplitude."""
    x = np.concatenate([np.full(rows - 1 - len(history), np.nan), history, new])
    w = np.lib.stride_tricks.sliding_window_view(x, rows)
    n = (~np.isnan(w)).sum(axis=1)
    d = w - np.nanmean(w, axis=1, keepdims=True)
    m2, m3, m4 = (np.nanmean(d**p, axis=1) for p in (2, 3, 4))
    with np.errstate(divide="ignore", invalid="ignore"):
        skew = np.where((n < 3) | (np.sqrt(m2) < K.EPS), 0.0, m3 / m2**1.5)
        kurt = np.where((n < 4) | (m2 < K.EPS), 0.0, m4 / m2**2 - 3.0)
    return skew, kurt


def score_of(f: dict[str, np.ndarray]) -> np.ndarray:
    total = 0.0
    for name, w, (lo, hi) in zip(K.FEATURES, K.DEFAULT_WEIGHTS, K.DEFAULT_RANGES, strict=True):
        if w:
            total = total + w * np.clip((f[name] - lo) / (hi - lo), 0.0, 1.0)
    return total


class PacketDetector:
    """State: last amplitudes, last packet of the first packet's length, that length, debounce state."""

    INPUTS = ("variance", "iqr", "spatial_gradient", "mean_amplitude")

    def __init__(self, detect: Machine, threshold: float):
        self.detect, self.threshold = detect, threshold
        self.start = ([], None, None, *detect.start)

    def step(self, c: Columns, state: tuple) -> tuple[Columns, tuple]:
        amps, prev, first_len, *mode = state
        f = {n: np.asarray(c[n], float) for n in self.INPUTS}
        history = np.asarray(amps, float)
        f["skewness"], f["kurtosis"] = windowed_moments(history, f["mean_amplitude"])
        delta = np.zeros(len(f["variance"]))
        lengths = np.array([len(x) for x in c["x"]])
        first_len = int(lengths[0]) if first_len is None else first_len
        same = np.flatnonzero(lengths == first_len)
        if len(same):
            xs = np.stack(list(c["x"][same])).astype(np.int64)
            before = xs[:1] if prev is None else np.asarray([prev], np.int64)
            delta[same] = np.abs(np.diff(np.vstack([before, xs]), axis=0)).mean(axis=1)
            prev = [int(v) for v in xs[-1]]
        f["temporal_delta_mean"] = delta
        score = score_of(f)
        out, end = self.detect.walk({"_sec": c["_sec"], "above": score > self.threshold}, tuple(mode))
        kept = np.concatenate([history, f["mean_amplitude"]])[-(K.MOMENT_ROWS - 1):]
        return {"score": score, **out}, ([float(v) for v in kept], prev, first_len, *end)
