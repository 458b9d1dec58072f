"""Path-dependent operators over the ordered rows of a device.

The debounce machine, the publish gate and the segmenter are all
sequential. A device that fits one task is simply walked from the start state. A hot
device is cut into pieces and walked in three steps:

1. every piece reports, for each state it could be entered in, the state it is left in;
2. those few rows are folded per device, a piece at a time, giving the state each piece really starts in;
3. every piece is walked from that state.

Step 1 stays small because an earlier event can influence a piece only through its
first rows: those within one persistence, heartbeat or segment length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rfsense.operators.layout import Layout
from rfsense.operators.walk import Columns, walk

State = tuple


@dataclass(frozen=True)
class Machine:
    """One sequential operator.

    cols: input columns beyond keys and order. state: state column DDL. start: initial state.
    walk(columns, state) -> (output columns, end state). ways_in(columns) -> summary rows.
    ways_schema: their DDL. through(state, summary rows) -> end state.
    """

    cols: tuple[str, ...]
    state: str
    start: State
    walk: Callable[[Columns, State], tuple[Columns, State]]
    out: str
    ways_in: Callable[[Columns], pd.DataFrame]
    ways_schema: str
    through: Callable[[State, pd.DataFrame], State]


def scan(lay: Layout, m: Machine, passthrough: tuple[str, ...] = (), explode: bool = False) -> DataFrame:
    """Walk every device. Output: keys, order, ``passthrough`` and the machine's columns per row,
    or with ``explode`` keys and the machine's own rows."""
    order, keys, part = lay.order, lay.keys, lay.part
    types = dict(lay.df.dtypes)
    base = list(dict.fromkeys([*keys, *([] if explode else [*order, *passthrough])]))
    cols = list(dict.fromkeys([*order, *base, *m.cols]))
    schema = ", ".join(f"`{c}` {types[c]}" for c in base) + ", " + m.out

    def emit(c: Columns, out: Columns) -> Columns:
        n = len(next(iter(out.values())))
        same = {k: np.repeat(c[k][:1], n) for k in keys} if explode else {k: c[k] for k in base}
        return {**same, **out}

    def on(c: Columns, state: State) -> tuple[Columns, State]:
        out, end = m.walk(c, state)
        return emit(c, out), end

    if not lay.pieces:
        return walk(lay.df, part, order, cols, lambda c, s: on(c, m.start if s is None else s), schema)

    part_ddl = ", ".join(f"`{c}` {types[c]}" for c in part)
    names = [f.split()[0] for f in m.state.split(",")]
    ways_names = [f.split()[0] for f in m.ways_schema.split(",")]

    def ways(c: Columns, _) -> tuple[Columns, None]:
        w = m.ways_in(c)
        return {**{k: np.repeat(c[k][:1], len(w)) for k in part}, **{k: w[k].to_numpy() for k in w}}, None

    def fold(c: Columns, held: tuple[State, int | None, list[Columns]] | None) -> tuple[Columns, tuple]:
        """The state each piece is entered in. Of the pieces' summaries only one is held at a time."""
        state, last, rows = held or (m.start, None, [])
        found: list[tuple] = []
        piece_of = c["_piece"]
        for at in np.split(np.arange(len(piece_of)), np.flatnonzero(np.diff(piece_of)) + 1):
            piece = int(piece_of[at[0]])
            if piece != last:
                if rows:
                    state = m.through(state, pd.DataFrame({k: np.concatenate([r[k] for r in rows]) for k in ways_names}))
                found.append((*(c[k][at[0]] for k in keys), piece, *state))
                last, rows = piece, []
            rows = [*rows, {k: c[k][at] for k in ways_names}]
        out = {n: np.empty(len(found), object) for n in [*part, *names]}
        for i, values in enumerate(found):
            for n, v in zip(out, values, strict=True):
                out[n][i] = v  # states may hold lists
        return out, (state, last, rows)

    def piece(c: Columns, state: State | None) -> tuple[Columns, State]:
        if state is None:
            state = tuple(c[n][0] for n in names) if c["_hot"][0] else m.start
        return on(c, state)

    # Devices that were not cut start in the start state and skip the first two steps.
    rows = lay.df.where("_core").withColumn("_hot", lay.hot())
    summary = walk(rows.where("_hot"), part, order, cols, ways, f"{part_ddl}, {m.ways_schema}", whole=True)
    entered = walk(summary, keys, ["_piece"], [*part, *ways_names], fold, f"{part_ddl}, {m.state}")
    return walk(rows.join(entered, part, "left"), part, order, [*cols, *names, "_hot"], piece, schema)


# --- debounce / persistence -------------------------------------------------------------

class _Debounce:
    """Entries and exits of one piece, found once for all the states it may be entered in."""

    def __init__(self, t: np.ndarray, above: np.ndarray, debounce: int, persistence: int):
        self.t, self.n, self.debounce, self.persistence = t, len(t), debounce, persistence
        idx = np.arange(self.n)
        self.below = np.flatnonzero(~above)
        self.t_below = t[self.below]
        self.run = idx - np.maximum.accumulate(np.where(above, -1, idx))
        self.lead = int(self.below[0]) if len(self.below) else self.n
        # The debounce-th row of a run of rows above is where an idle device enters.
        self.entries = np.flatnonzero(above & (self.run == debounce))
        self.exits = self.exit_of(self.t[self.entries], self.entries)
        self.then = np.searchsorted(self.entries, self.exits, side="right")

    def exit_of(self, t0, at):
        """Row of the first value not above from ``at`` on that is later than t0 + persistence; n if none."""
        k = np.maximum(np.searchsorted(self.t_below, t0 + self.persistence, side="right"),
                       np.searchsorted(self.below, at))
        return np.append(self.below, self.n)[k]

    def idle_end(self, consec: int = 0) -> State:
        tail = int(self.run[-1])
        return 0, tail + (consec if self.lead == self.n else 0), 0

    def spans(self, state: State):
        """Detected spans as (first row, exit row) from ``state``, and the end state."""
        mode, consec, t0 = (int(v) for v in state)
        found = []
        if mode == 1:
            j = int(self.exit_of(t0, 0))
            found.append((0, j))
            if j == self.n:
                return found, (1, 0, t0)
            k = int(np.searchsorted(self.entries, j, side="right"))
        elif consec and self.debounce - consec - 1 < self.lead:
            at = self.debounce - consec - 1
            j = int(self.exit_of(self.t[at], at))
            found.append((at, j))
            if j == self.n:
                return found, (1, 0, int(self.t[at]))
            k = int(np.searchsorted(self.entries, j, side="right"))
        else:
            # Carried rows not reaching the count leave the leading run without an entry.
            k = int(np.searchsorted(self.entries, self.lead)) if consec else 0
        more, end = self.chain(k, consec if not found else 0)
        return found + more, end

    def chain(self, k: int, consec: int = 0):
        found = []
        while k < len(self.entries):
            at, j = int(self.entries[k]), int(self.exits[k])
            found.append((at, j))
            if j == self.n:
                return found, (1, 0, int(self.t[at]))
            k = int(self.then[k])
        return found, self.idle_end(consec if not found else 0)


def debounce_machine(debounce: int = 10, persistence: int = 3) -> Machine:
    """IDLE -> DETECTED after ``debounce`` rows above in a row; back on the first row not above later
    than ``persistence`` seconds after the detection began. Needs columns _sec and above."""
    if debounce < 1:
        raise ValueError("debounce must be at least 1")

    def piece(c: Columns) -> _Debounce:
        return _Debounce(np.asarray(c["_sec"], np.int64), np.asarray(c["above"], bool), debounce, persistence)

    def step(c: Columns, s: State):
        p = piece(c)
        spans, end = p.spans(s)
        state = np.full(p.n, "IDLE", dtype=object)
        fell = np.zeros(p.n, dtype=bool)
        for at, j in spans:
            state[at:j] = "DETECTED"
            if j < p.n:
                fell[j] = True
        return {"state": state, "downgraded": fell}, end

    def ways(c: Columns) -> pd.DataFrame:
        p = piece(c)
        rows = [(0, c, *p.spans((0, c, 0))[1]) for c in range(debounce)]
        # A detection from before this piece ends on one of the first values not above.
        near = int(np.searchsorted(p.t_below, p.t[0] + persistence, side="right")) + 1
        memo: dict[int, State] = {}
        for b in p.below[:near]:
            k = int(np.searchsorted(p.entries, b, side="right"))
            if k not in memo:
                memo[k] = p.chain(k)[1]
            if rows[-1][0] == 1 and rows[-1][2:] == memo[k]:
                rows.pop()
            rows.append((1, int(p.t[b]), *memo[k]))
        return pd.DataFrame(rows, columns=["kind", "key", "mode", "consec", "t0"])

    def through(s: State, w: pd.DataFrame) -> State:
        if s[0] == 0:
            hit = w[(w.kind == 0) & (w.key == s[1])]
        else:
            hit = w[(w.kind == 1) & (w.key > s[2] + persistence)].sort_values("key").head(1)
        if hit.empty:
            return tuple(int(v) for v in s)
        r = hit.iloc[0]
        return int(r["mode"]), int(r.consec), int(r.t0)

    return Machine(("_sec", "above"), "_mode int, _consec int, _t0 bigint", (0, 0, 0), step,
                   "state string, downgraded boolean", ways,
                   "kind int, key bigint, mode int, consec int, t0 bigint", through)


# --- change / delta / heartbeat gate ----------------------------------------------------

class _Gate:
    def __init__(self, c: Columns, delta: float, heartbeat: int):
        self.t = np.asarray(c["_ms"], np.int64)
        self.state = np.asarray(c["state"], object)
        self.score = np.asarray(c["score"], float)
        self.lists = self.t.tolist(), self.state.tolist(), self.score.tolist()
        self.n, self.delta, self.heartbeat = len(self.t), delta, heartbeat

    def next_from(self, at: int, t: int, state: str, score: float) -> int:
        """First row from ``at`` on that must be sent after the given last sent values; n if none."""
        ts, states, scores = self.lists
        due = t + self.heartbeat
        # Most gaps are short: look at the next rows one by one before searching in blocks.
        near = min(at + 16, self.n)
        while at < near:
            if states[at] != state or abs(scores[at] - score) > self.delta or ts[at] >= due:
                return at
            at += 1
        stop, width = max(int(np.searchsorted(self.t, due)), at), 64
        stop = min(stop, self.n)
        while at < stop:
            hi = min(at + width, stop)
            hit = (self.state[at:hi] != state) | (np.abs(self.score[at:hi] - score) > self.delta)
            if hit.any():
                return at + int(hit.argmax())
            at, width = hi, width * 2
        return stop

    def sent(self, first: int, stop_at: dict[int, int] | None = None) -> tuple[list[int], int]:
        """Rows sent when ``first`` is, and the last of them; stops on a row whose end is known."""
        rows, i = [], first
        while i < self.n:
            if stop_at is not None and i in stop_at:
                return rows, stop_at[i]
            rows.append(i)
            i = self.next_from(i + 1, self.lists[0][i], self.lists[1][i], self.lists[2][i])
        return rows, rows[-1]


def gate_machine(delta: float = 0.05, heartbeat_ms: int = 5000) -> Machine:
    """Send the first row, a changed state, a score further than ``delta`` from the last sent one, or
    after ``heartbeat_ms``. Needs columns _ms, state and score."""
    never = (False, 0, "", 0.0)

    def step(c: Columns, s: State):
        g = _Gate(c, delta, heartbeat_ms)
        first = g.next_from(0, int(s[1]), s[2], float(s[3])) if s[0] else 0
        out = np.zeros(g.n, dtype=bool)
        end = s
        if first < g.n:
            rows, last = g.sent(first)
            out[rows] = True
            end = (True, int(g.t[last]), g.state[last], float(g.score[last]))
        return {"published": out}, end

    def ways(c: Columns) -> pd.DataFrame:
        g = _Gate(c, delta, heartbeat_ms)
        # The heartbeat forces a send within one interval, so only these rows can be sent first.
        near = min(int(np.searchsorted(g.t, g.t[0] + heartbeat_ms)) + 1, g.n)
        known: dict[int, int] = {}
        for i in reversed(range(near)):
            rows, last = g.sent(i, known)
            known.update(dict.fromkeys(rows, last))
        return pd.DataFrame([
            (int(g.t[i]), g.state[i], float(g.score[i]),
             int(g.t[known[i]]), g.state[known[i]], float(g.score[known[i]])) for i in range(near)
        ], columns=["t", "s", "v", "end_t", "end_s", "end_v"]).assign(i=range(near))

    def through(s: State, w: pd.DataFrame) -> State:
        w = w.sort_values("i")
        hit = w if not s[0] else w[(w.s != s[2]) | ((w.v - s[3]).abs() > delta) | (w.t - s[1] >= heartbeat_ms)]
        if hit.empty:
            return s
        r = hit.iloc[0]
        return True, int(r.end_t), str(r.end_s), float(r.end_v)

    return Machine(("_ms", "state", "score"), "_sent boolean, _last_ms bigint, _last_state string, _last_score double",
                   never, step, "published boolean", ways,
                   "t bigint, s string, v double, end_t bigint, end_s string, end_v double, i int", through)


# --- motion segmentation ----------------------------------------------------------------

class _Segments:
    """Segments of one piece against one threshold and cap."""

    def __init__(self, mv: np.ndarray, thr: float, longest: int):
        self.n, self.longest = len(mv), max(longest, 2)
        self.over = np.flatnonzero(mv > thr)
        self.under = np.flatnonzero(mv < thr)

    def close_of(self, opened: int) -> int:
        """Row that closes a segment opened at ``opened`` (negative: before this piece); n if none."""
        k = int(np.searchsorted(self.under, max(opened + 1, 0)))
        u = int(self.under[k]) if k < len(self.under) else self.n
        return min(u, max(opened + self.longest - 1, 0), self.n)

    def walk(self, opened: int | None, known: dict[int, int | None] | None = None):
        """(start, length) of segments closed here, relative to this piece, and the open start or None."""
        found, at = [], 0
        if opened is not None:
            c = self.close_of(opened)
            if c == self.n:
                return found, opened
            found.append((opened, c - opened + 1))
            at = c + 1
        while True:
            k = int(np.searchsorted(self.over, at))
            if k == len(self.over):
                return found, None
            o = int(self.over[k])
            if known is not None and o in known:
                return found, known[o]
            c = self.close_of(o)
            if c == self.n:
                return found, o
            found.append((o, c - o + 1))
            at = c + 1

    def end_after(self, opened: int | None, memo: dict[int, int | None]) -> int | None:
        found, end = self.walk(opened, memo)
        for o, _ in found:
            if o >= 0:
                memo[o] = end
        return end


NO_SEGMENT = -1


def segment_machine(configs: list[tuple[int, str, str, int]], shortest: dict[int, list[int]] | None = None) -> Machine:
    """Motion segments for each (id, moving-variance column, threshold column, longest).

    The state is the position at which each configuration's segment is open, or -1. With
    ``shortest`` (id -> minimum lengths) only segment counts per minimum are given.
    """
    cols = tuple(dict.fromkeys(["_pos", *[c for _, mv, th, _ in configs for c in (mv, th)]]))

    def piece(c: Columns, mv: str, th: str, longest: int) -> _Segments | None:
        thr = c[th][0]
        return None if thr is None or np.isnan(thr) else _Segments(np.asarray(c[mv], float), float(thr), longest)

    def step(c: Columns, s: State):
        p0, opens, rows = int(c["_pos"][0]), [], []
        for (cid, mv, th, longest), o in zip(configs, list(s[0]), strict=True):
            seg = piece(c, mv, th, longest)
            if seg is None:
                opens.append(NO_SEGMENT)
                continue
            found, end = seg.walk(None if o == NO_SEGMENT else int(o) - p0)
            opens.append(NO_SEGMENT if end is None else end + p0)
            if shortest is None:
                rows += [(cid, st + p0, ln) for st, ln in found]
            else:
                lens = np.array([ln for _, ln in found])
                rows += [(cid, mn, int((lens >= mn).sum())) for mn in shortest[cid]]
        names = ["config", "start_pos", "length"] if shortest is None else ["config", "min_length", "segments"]
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        return dict(zip(names, table.T, strict=True)), (opens,)

    def ways(c: Columns) -> pd.DataFrame:
        p0, rows = int(c["_pos"][0]), []
        for n, (_, mv, th, longest) in enumerate(configs):
            seg = piece(c, mv, th, longest)
            if seg is None:
                continue
            memo: dict[int, int | None] = {}
            for back in range(min(seg.longest, p0 + 1)):
                # back 0: no open segment; otherwise one opened ``back`` rows before this piece.
                end = seg.end_after(None if back == 0 else -back, memo)
                rows.append((n, NO_SEGMENT if back == 0 else p0 - back,
                             NO_SEGMENT if end is None else end + p0))
        return pd.DataFrame(rows, columns=["c", "open_in", "open_out"])

    def through(s: State, w: pd.DataFrame) -> State:
        table = {(int(a), int(b)): int(e) for a, b, e in zip(w.c, w.open_in, w.open_out)}
        return ([table.get((c, int(o)), NO_SEGMENT) for c, o in enumerate(s[0])],)

    out = ("config bigint, start_pos bigint, length bigint" if shortest is None
           else "config bigint, min_length bigint, segments bigint")
    return Machine(cols, "_open array<bigint>", ([NO_SEGMENT] * len(configs),), step, out, ways,
                   "c int, open_in bigint, open_out bigint", through)
