"""Arithmetic of ticks: a clock that looks at the latest state every period, whether or not a row came.

Tick k lies at k periods. A row is what the clock sees from the first tick at or after it up to the last tick before the next row; a row
with no tick in between is never seen. A device that the clock sees idle is reset every ``timeout`` after the last tick at which it
moved, so the resets of a whole gap follow from its ends, and no tick has to be built.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense.operators.layout import Profile, arrange


@dataclass(frozen=True)
class TickClock:
    """Resets of one device: state (first tick not looked at, whether the latest row moves, last tick that moved, resets so far)."""

    timeout_ms: int
    period_ms: int

    @property
    def step(self) -> int:
        """Ticks from the last movement, or reset, to a reset; 0 never resets."""
        return -(-self.timeout_ms // self.period_ms)

    def walk(self, us: np.ndarray, moving: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        """The ticks with resets before the last of these ordered rows, and the state after them."""
        open_, was, moved, resets = state
        first = -(-us // (self.period_ms * 1000))
        if open_ is not None:
            first, moving = np.concatenate(([int(open_)], np.maximum(first, int(open_)))), np.concatenate(([bool(was)], moving))
        lo, hi, moving_now = first[:-1], first[1:] - 1, moving[:-1]
        seen = hi >= lo
        none = np.iinfo(np.int64).min
        own = np.where(seen & moving_now, hi, none)
        last = np.maximum.accumulate(np.concatenate(([none if moved is None else int(moved)], own)))
        ticks = self._between(lo, hi, last[:-1], seen & ~moving_now & (last[:-1] > none))
        moved = None if last[-1] == none else int(last[-1])
        return ticks, (int(first[-1]), bool(moving[-1]), moved, int(resets) + len(ticks))

    def until(self, upto: int, state: tuple) -> tuple[np.ndarray, tuple]:
        """The ticks with resets before tick ``upto`` without a further row."""
        open_, moving, moved, resets = state
        if open_ is None or upto <= int(open_):
            return np.zeros(0, np.int64), state
        if moving:
            return np.zeros(0, np.int64), (upto, True, upto - 1, resets)
        one = np.array([int(open_)])
        ticks = self._between(one, np.array([upto - 1]), np.array([int(moved or 0)]), np.array([moved is not None]))
        return ticks, (upto, False, moved, int(resets) + len(ticks))

    def next(self, state: tuple) -> int | None:
        """The next tick with a reset if no row comes."""
        open_, moving, moved, _ = state
        if open_ is None or moving or moved is None or not self.step:
            return None
        return int(moved) + self.step * max(1, -(-(int(open_) - int(moved)) // self.step))

    def _between(self, lo: np.ndarray, hi: np.ndarray, moved: np.ndarray, idle: np.ndarray) -> np.ndarray:
        if not self.step or not idle.any():
            return np.zeros(0, np.int64)
        lo, hi, moved = lo[idle], hi[idle], moved[idle]
        first = np.maximum(1, -(-(lo - moved) // self.step))
        n = np.maximum(0, (hi - moved) // self.step - first + 1)
        return np.repeat(moved + (first - (np.cumsum(n) - n)) * self.step, n) + np.arange(int(n.sum())) * self.step


def tick_of(ts: Column, period_seconds: int) -> Column:
    """The first tick at or after a time."""
    return F.ceil(F.unix_micros(ts) / F.lit(period_seconds * 1_000_000.0)).cast("long")


def idle_resets(states: DataFrame, timeout: int, period_seconds: int = 1, piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """The rows with ``epoch``, the number of resets of the device at ticks before the row, and ``resets``, those at ticks from the row to just
    before the next one.

    A device is reset at a tick once it has been seen idle for ``timeout`` seconds since the last tick at which it moved, and again after each further ``timeout``; 0
    disables. Without a movement before there is no reset. Windows and sums only: hot devices are cut into pieces, which hand on one row each.
    """
    lay = arrange(states, after=1, piece_rows=piece_rows, profile=profile)
    step = -(-timeout // period_seconds)
    df = lay.df.withColumns({"_lo": tick_of(F.col("ts"), period_seconds),
                             "_hi": tick_of(F.lead("ts").over(lay.ordered()), period_seconds) - 1})
    moving, seen = F.col("state") != "IDLE", F.col("_hi") >= F.col("_lo")
    df = lay.carry(df, {"_moved": F.when(seen & moving, F.col("_hi"))}, inclusive=False)

    def upto(tick: Column) -> Column:
        return F.floor((tick - F.col("_moved")) / F.lit(float(max(step, 1)))).cast("long")

    some = seen & ~moving & F.col("_moved").isNotNull() & F.lit(step > 0)
    df = df.withColumn("resets", F.when(some, upto(F.col("_hi")) - upto(F.col("_lo") - 1)).otherwise(0).cast("long"))
    df = lay.sum_before(df, "resets", "epoch")
    return lay.done(df).drop("_lo", "_hi", "_moved")
