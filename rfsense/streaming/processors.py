"""Stateful processors, one state per share of the devices.

The sequential machines of the batch side take a state and give one back, so the same code
runs here with the state kept between micro-batches. Rows wait on a time line, in buckets of time, until the watermark has passed
their bucket, so the order in which files and micro-batches bring them does not matter within the tolerance of the watermark.
One event-time timer per share wakes it for its next bucket, or for whatever is due to a device without a row: ticks, resets, alerts.

A call into the state costs the same for one row as for a thousand, and a series has only a few rows a day: with a state per device
the calls were nearly all of the time. Devices of a share have their buckets and timer in common; each keeps its own machine,
late rows and moment up to which it was given, so the results do not depend on who shares with whom.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rfsense import constants as K
from rfsense.operators.online import PacketDetector
from rfsense.operators.scan import Machine
from rfsense.operators.ticks import TickClock

NEVER = -(2**62)

PUT_ROWS = 1000
"""Rows of a state entry."""
FRAME = 20_000
"""Rows that are worked on, or given, together."""
RUN = 10_000
"""Ticks of a row of ``TickProcessor``."""

Columns = dict[str, np.ndarray]
Work = Generator[Columns, None, tuple]
Outputs = Iterator[tuple[str | None, Columns]]


def plain(values: pd.Series) -> list:
    """Python values for the state store; what is missing is None."""
    return [list(map(int, v)) if isinstance(v, np.ndarray) else None if v is None or v is pd.NA or v != v else v for v in values.tolist()]


def instants(us: np.ndarray) -> np.ndarray:
    return np.asarray(us, np.int64).view("datetime64[us]")


def lists(ddl: str) -> str:
    """The columns of a DDL as arrays."""
    return ", ".join(f"{n} array<{t}>" for n, t in (f.split(" ", 1) for f in ddl.split(", ")))


def joined(parts: list) -> pd.Series:
    """One column of the parts of several devices; times are UTC."""
    if not all(isinstance(v, np.ndarray) for v in parts):
        return pd.concat([pd.Series(v) for v in parts], ignore_index=True)
    column = pd.Series(np.concatenate(parts))
    return column.dt.tz_localize("UTC") if column.dtype.kind == "M" else column


class TimelineProcessor(StatefulProcessor):
    """Holds the rows of a share of the devices in buckets of ``bucket_ms`` until the watermark has passed the bucket, then works on each device's by (ts,
    ``first``, seq).

    A row of a bucket that its device was given already, or of an earlier one, comes too late: it is left out and counted. The state holds the
    buckets of the tolerance and of one micro-batch, and a machine per device. Rows are held in parts of ``PUT_ROWS`` in the order of their buckets; parts are read and taken
    out one by one, and rows are worked on ``FRAME`` at a time. Devices are told by text.
    """

    def __init__(self, fields: str, state: str, start: tuple, bucket_ms: int = 1000, first: str | None = None):
        self.bucket, self.start, self.state, self.first = bucket_ms, start, state, first
        parts = [f.split(" ", 1) for f in fields.split(", ")] if fields else []
        self.names = ["device_id", "_us", "seq", *(n for n, _ in parts)]
        # A device's values have the type that they have by themselves, whatever others of its share have.
        self.own_type = ["seq", *(n for n, t in parts if t != "string" and not t.startswith("array"))]
        self.held_as = lists("device_id string, _us bigint, seq bigint" + (f", {fields}" if fields else ""))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "part bigint", self.held_as)
        self.line = handle.getValueState("line", "timer bigint, due bigint, next bigint, parts array<bigint>, begins array<bigint>")
        self.machines = handle.getValueState("machines", lists(f"device_id string, {self.state}, given bigint, late bigint"))

    def _load(self) -> tuple[int, int | None, int, dict[int, int]]:
        """The timer, when something is due without a row, the number of the next part, and the first bucket of each part held."""
        found = self.line.get()
        if found is None:
            return NEVER, None, 0, {}
        timer, due, number, parts, begins = found
        return int(timer), None if due is None else int(due), int(number), dict(zip(map(int, parts), map(int, begins), strict=True))

    def _store(self, timer: int, due: int | None, number: int, parts: dict[int, int]) -> None:
        """Writes the line, and wakes the share at its first bucket's end or at ``due``."""
        wakes = [(min(parts.values()) + 1) * self.bucket] if parts else []
        wake = min(wakes if due is None else [*wakes, due], default=NEVER)
        if wake != timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            if wake != NEVER:
                self.handle.registerTimer(wake)
        self.line.update((wake, due, number, list(parts), list(parts.values())))

    def _put(self, columns: list[list], bucket: np.ndarray, at: np.ndarray, number: int, parts: dict[int, int]) -> int:
        """Holds the rows ``at``, in the order of their buckets; the number of the next part."""
        at = at[np.argsort(bucket[at], kind="stable")]
        for some in (at[i:i + PUT_ROWS].tolist() for i in range(0, len(at), PUT_ROWS)):
            self.held.updateValue((number,), tuple([c[i] for i in some] for c in columns))
            parts[number] = int(bucket[some[0]])
            number += 1
        return number

    def _devices(self) -> dict[str | None, list]:
        """By device: its machine's state, the time up to which it was given, its late rows."""
        found = self.machines.get()
        return {} if found is None else {d: own for d, *own in zip(*found, strict=True)}

    def _keep(self, devices: dict[str | None, list]) -> None:
        if devices:
            self.machines.update((list(devices), *(list(v) for v in zip(*devices.values(), strict=True))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (timer, due, number, parts), devices, counted = self._load(), self._devices(), False
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            bucket = us // (self.bucket * 1000)
            device = plain(pdf["device_id"])
            fresh = (bucket + 1) * self.bucket > np.array([devices[d][-2] if d in devices else NEVER for d in device], np.int64)
            for i in np.flatnonzero(~fresh).tolist():
                devices[device[i]][-1] += 1
                counted = True
            columns = [device, us.tolist(), [None if v is None else int(v) for v in plain(pdf["seq"])], *(plain(pdf[c]) for c in self.names[3:])]
            number = self._put(columns, bucket, np.flatnonzero(fresh), number, parts)
        if counted:
            self._keep(devices)
        self._store(timer, due, number, parts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (_, _, number, parts), devices = self._load(), self._devices()
        passed = timerValues.getCurrentWatermarkInMs() // self.bucket * self.bucket
        woken = {d for d, own in devices.items() if (due := self.due(own[:-2], own[-2])) is not None and due <= passed} if self.silent else set()
        ends, first = passed // self.bucket, self.names.index(self.first) if self.first else 1
        some = sorted((p for p, b in parts.items() if b < ends), key=parts.get)
        found: list[tuple] = []
        ready: list[tuple] = []
        for k, part in enumerate(some):
            found += zip(*self.held.getValue((part,)), strict=True)
            self.held.removeKey((part,))
            # Rows before the first bucket of the next part are all there.
            upto = min(ends, parts[some[k + 1]] if k + 1 < len(some) else ends) * self.bucket * 1000
            whole = [r for r in found if r[1] < upto]
            if not whole:
                continue
            found = [r for r in found if r[1] >= upto]
            ready += sorted(whole, key=lambda r: (r[1], r[first], r[2] is None, r[2] or 0))
            for d, us in {r[0]: r[1] for r in ready[-len(whole):]}.items():
                own = devices.setdefault(d, [*self.start, NEVER, 0])
                own[-2] = max(own[-2], (us // (self.bucket * 1000) + 1) * self.bucket)
                woken.add(d)
            while len(ready) >= FRAME:
                yield from self._frames(self._worked(ready[:FRAME], devices))
                ready = ready[FRAME:]
        for part in some:
            del parts[part]
        if ready:
            yield from self._frames(self._worked(ready, devices))
        if found:
            bucket = np.array([r[1] for r in found], np.int64) // (self.bucket * 1000)
            number = self._put([list(c) for c in zip(*found, strict=True)], bucket, np.arange(len(found)), number, parts)
        due = None
        if self.silent:
            yield from self._frames(self._silenced(woken, devices, passed))
            due = min((at for own in devices.values() if (at := self.due(own[:-2], own[-2])) is not None), default=None)
        self._keep(devices)
        self._store(NEVER, due, number, parts)

    def _worked(self, ready: list[tuple], devices: dict[str | None, list]) -> Outputs:
        """What the machines give for rows in the order of time, device by device."""
        number: dict[str | None, int] = {}
        of = np.fromiter((number.setdefault(r[0], len(number)) for r in ready), np.int64, len(ready))
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(number))).tolist()
        _, *columns = zip(*ready, strict=True)
        rows = {c: pd.Series(v, dtype=object).infer_objects().to_numpy()[order] for c, v in zip(self.names[1:], columns, strict=True)}
        rows["_us"] = rows["_us"].astype(np.int64)
        rows["_ms"], rows["_sec"] = rows["_us"] // 1000, rows["_us"] // 1_000_000
        mixed = [c for c in self.own_type if rows[c].dtype == object]
        for device, lo, hi in zip(number, [0, *ends], ends, strict=False):
            own = {c: v[lo:hi] for c, v in rows.items()}
            own |= {c: pd.Series(own[c], dtype=object).infer_objects().to_numpy() for c in mixed}
            *state, given, self.late = devices[device]
            state = yield from self._each(device, self.work(own, tuple(state)))
            devices[device] = [*state, given, self.late]

    def _silenced(self, woken: set[str | None], devices: dict[str | None, list], passed: int) -> Outputs:
        for device in woken:
            *state, given, late = devices[device]
            state = yield from self._each(device, self.silence(tuple(state), passed))
            devices[device] = [*state, max(given, passed), late]

    @staticmethod
    def _each(device: str | None, work: Work) -> Generator[tuple[str | None, Columns], None, tuple]:
        """The work's columns, each with the device; its value is the state after it."""
        try:
            while True:
                yield device, next(work)
        except StopIteration as end:
            return end.value

    @staticmethod
    def _frames(outputs: Outputs) -> Iterator[pd.DataFrame]:
        """Outputs of many devices in frames of at most ``FRAME`` rows."""
        def frame() -> pd.DataFrame:
            device = np.repeat(np.array([d for d, _, _ in gathered], object), [n for _, n, _ in gathered])
            return pd.DataFrame({"device_id": device, **{c: joined([out[c] for *_, out in gathered]) for c in gathered[0][2]}})

        gathered: list[tuple] = []
        room = FRAME
        for device, out in outputs:
            n = len(next(iter(out.values())))
            at = 0
            while at < n:
                some = min(room, n - at)
                gathered.append((device, some, {c: v[at:at + some] for c, v in out.items()}))
                at, room = at + some, room - some
                if not room:
                    yield frame()
                    gathered, room = [], FRAME
        if gathered:
            yield frame()

    silent = False
    """Whether a device does something without rows: ``silence`` and ``due``."""

    def work(self, rows: Columns, state: tuple) -> Work:
        """Gives output columns for ordered rows; returns the state after them."""
        raise NotImplementedError

    def silence(self, state: tuple, passed: int) -> Work:
        """Gives what happens before ``passed`` (ms) without a further row."""
        yield from ()
        return state

    def due(self, state: tuple, given: int) -> int | None:
        """When (ms) to wake although no row waits."""
        return None

    def close(self) -> None:
        pass


def with_order(rows: Columns, out: Columns) -> Columns:
    return {"ts": instants(rows["_us"]), "seq": rows["seq"], **out}


class MachineProcessor(TimelineProcessor):
    """Runs a batch machine over the stream; the columns ``passthrough`` come along."""

    def __init__(self, machine: Machine, fields: str, passthrough: tuple[str, ...], bucket_ms: int = 1000):
        super().__init__(fields, machine.state, machine.start, bucket_ms)
        self.machine, self.passthrough = machine, passthrough

    def work(self, rows: Columns, state: tuple) -> Work:
        out, end = self.machine.walk(rows, state)
        yield with_order(rows, {c: rows[c] for c in self.passthrough} | dict(out))
        return end


class MotionDetector(TimelineProcessor):
    """Per packet: deltas to the previous packet, moving moments, score, debounced state, publish flag."""

    STATE = ("amps array<double>, prev array<int>, first_len int, mode int, consec int, t0 bigint, "
             "sent boolean, last_ms bigint, last_state string, last_score double")

    def __init__(self, detect: Machine, gate: Machine, threshold: float, bucket_ms: int = 1000):
        self.detector, self.gate, self.threshold = PacketDetector(detect, threshold), gate, threshold
        super().__init__("x array<int>, " + ", ".join(f"{c} double" for c in self.detector.INPUTS), self.STATE,
                         (*self.detector.start, *gate.start), bucket_ms)

    def work(self, rows: Columns, state: tuple) -> Work:
        seen, sent = state[:6], state[6:]
        d, seen = self.detector.step(rows, seen)
        g, sent = self.gate.walk({"_ms": rows["_ms"], "state": d["state"], "score": d["score"]}, sent)
        conf = (np.minimum(1.0, d["score"] / (self.threshold + K.EPS)) if self.threshold > K.EPS
                else (d["score"] > 0).astype(float))
        yield with_order(rows, {"score": d["score"], "state": d["state"], "confidence": np.where(d["downgraded"], 0.0, conf),
                                "published": g["published"], "late": np.full(len(d["score"]), self.late)})
        return (*seen, *sent)


class TickProcessor(TimelineProcessor):
    """The latest values at every tick from a device's first row on, also for ticks without a row: a timer that renews itself.

    A tick is given once the watermark has passed it, so that no row before it can come any more. Ticks with the same values come as one row (``first``
    to ``last``, at most ``RUN``), to be spread out by Spark.
    """

    silent = True

    def __init__(self, period_ms: int, values: str, bucket_ms: int = 1000):
        self.period, self.values = period_ms, [f.split()[0] for f in values.split(", ")]
        super().__init__(values, f"tick bigint, {values}", (None, *([None] * len(self.values))), bucket_ms)

    def _runs(self, first: np.ndarray, values: list[np.ndarray], upto: int) -> Iterator[Columns]:
        """Ticks ``first[0]`` to ``upto - 1``; row i holds from tick ``first[i]`` on."""
        end = np.append(first[1:], upto)
        n = np.maximum(0, -(-(end - first) // RUN))
        row = np.repeat(np.arange(len(first)), n)
        if len(row):
            begin = first[row] + (np.arange(len(row)) - (np.cumsum(n) - n)[row]) * RUN
            yield {"first": begin, "last": np.minimum(begin + RUN, end[row]) - 1, **{c: v[row] for c, v in zip(self.values, values, strict=True)}}

    def work(self, rows: Columns, state: tuple) -> Work:
        first = -(-rows["_us"] // (self.period * 1000))
        values = [rows[c] for c in self.values]
        if state[0] is not None:
            first = np.concatenate(([int(state[0])], np.maximum(first, int(state[0]))))
            values = [np.concatenate((np.array([s], v.dtype), v)) for s, v in zip(state[1:], values, strict=True)]
        yield from self._runs(first, values, int(first[-1]))
        return (int(first[-1]), *(v[-1].item() if isinstance(v[-1], np.generic) else v[-1] for v in values))

    def silence(self, state: tuple, passed: int) -> Work:
        if state[0] is None:
            return state
        upto = max(int(state[0]), (passed - 1) // self.period + 1)
        yield from self._runs(np.array([int(state[0])]), [np.array([v], object) for v in state[1:]], upto)
        return (upto, *state[1:])

    def due(self, state: tuple, given: int) -> int | None:
        return None if state[0] is None else (int(state[0]) * self.period // self.bucket + 1) * self.bucket


class IdleResets(TimelineProcessor):
    """The ticks at which a device that stays idle is reset, also without rows: a timer that renews itself while the device is idle."""

    silent = True

    def __init__(self, clock: TickClock, bucket_ms: int = 1000):
        self.clock = clock
        super().__init__("state string", "open bigint, moving boolean, moved bigint, resets bigint", (None, False, None, 0), bucket_ms)

    def _out(self, ticks: np.ndarray, before: int) -> Columns:
        return {"reset_ts": instants(ticks * self.clock.period_ms * 1000), "resets": before + 1 + np.arange(len(ticks))}

    def work(self, rows: Columns, state: tuple) -> Work:
        ticks, end = self.clock.walk(rows["_us"], rows["state"] != "IDLE", state)
        if len(ticks):
            yield self._out(ticks, int(state[3]))
        return end

    def silence(self, state: tuple, passed: int) -> Work:
        ticks, end = self.clock.until((passed - 1) // self.clock.period_ms + 1, state)
        if len(ticks):
            yield self._out(ticks, int(state[3]))
        return end

    def due(self, state: tuple, given: int) -> int | None:
        tick = self.clock.next(state)
        return None if tick is None else (tick * self.clock.period_ms // self.bucket + 1) * self.bucket


class InactivityAlerts(TimelineProcessor):
    """An alert when a device has been idle for ``idle_ms``, if that moment lies in the given hours of the day. A change of state cancels it."""

    silent = True

    def __init__(self, idle_ms: int, from_hour: int, to_hour: int, bucket_ms: int = 1000):
        self.idle_us, self.hours = idle_ms * 1000, (from_hour, to_hour)
        super().__init__("state string", "last string, since bigint", (None, None), bucket_ms)

    def _out(self, since: np.ndarray) -> Iterator[Columns]:
        hour = (since + self.idle_us) // 3_600_000_000 % 24
        since = since[(hour >= self.hours[0]) & (hour < self.hours[1])]
        if len(since):
            yield {"idle_since": instants(since), "alert_ts": instants(since + self.idle_us)}

    def work(self, rows: Columns, state: tuple) -> Work:
        last, since = state
        s, us = rows["state"], rows["_us"]
        change = np.flatnonzero(s != np.concatenate((np.array([last], object), s[:-1])))
        starts = np.concatenate((np.array([] if since is None else [int(since)], np.int64), us[change]))
        idle = np.concatenate((np.array([] if since is None else [True], bool), s[change] == "IDLE"))
        # A spell ends with the next change; the last one stays open. One whose alert was given has no ``since``.
        if len(starts) and len(change):
            done = starts[:-1][idle[:-1] & (starts[1:] - starts[:-1] >= self.idle_us)]
            yield from self._out(done)
            since = int(starts[-1]) if idle[-1] else None
        return s[-1], since

    def silence(self, state: tuple, passed: int) -> Work:
        last, since = state
        if since is not None and int(since) + self.idle_us < passed * 1000:
            yield from self._out(np.array([int(since)], np.int64))
            since = None
        return last, since

    def due(self, state: tuple, given: int) -> int | None:
        return None if state[1] is None else ((int(state[1]) + self.idle_us) // 1000 // self.bucket + 1) * self.bucket


class PhaseCollector(TimelineProcessor):
    """The first ``samples`` rows of a device are BASELINE, the next ``samples`` MOVEMENT; a notice goes out with the first row of each phase."""

    def __init__(self, samples: int, bucket_ms: int = 1000):
        self.samples = samples
        super().__init__("", "n bigint", (0,), bucket_ms)

    def work(self, rows: Columns, state: tuple) -> Work:
        n = int(state[0]) + np.arange(len(rows["_us"]))
        phase = np.where(n < self.samples, "BASELINE", np.where(n < 2 * self.samples, "MOVEMENT", None)).astype(object)
        begins = (n % self.samples == 0) & (n <= 2 * self.samples)
        yield with_order(rows, {"phase": phase, "sample_in_phase": pd.arrays.IntegerArray(n % self.samples + 1, n >= 2 * self.samples),
                                "begins": begins})
        return (min(int(n[-1]) + 1, 2 * self.samples + 1),)


class ConfigAsOf(TimelineProcessor):
    """Commands (kind 0) and rows (kind 1) of a device on one time line: each row with the settings in force, commands of its own time included."""

    def __init__(self, settings: dict[str, tuple[str, float]], fields: str, bucket_ms: int = 1000):
        """``settings``: command -> (column, default)."""
        self.settings, self.kept = settings, [f.split()[0] for f in fields.split(", ")]
        columns = [c for c, _ in settings.values()]
        super().__init__("kind int, cmd string, setting double, " + fields, ", ".join(f"{c} double" for c in columns), tuple(d for _, d in settings.values()), bucket_ms, "kind")

    def work(self, rows: Columns, state: tuple) -> Work:
        cmd, value = rows["cmd"], rows["setting"].astype(float)
        is_row = rows["kind"].astype(int) == 1
        out, end = {c: rows[c][is_row] for c in self.kept}, []
        for (name, (column, default)), now in zip(self.settings.items(), state, strict=True):
            written = np.concatenate(([now], np.where(cmd == name, value, default)))
            at = np.maximum.accumulate(np.where(np.concatenate(([True], (cmd == name) | (cmd == "factory_reset"))), np.arange(len(written)), 0))
            out[column] = written[at][1:][is_row]
            end.append(float(written[at][-1]))
        if is_row.any():
            yield {"ts": instants(rows["_us"][is_row]), "seq": rows["seq"][is_row], **out}
        return tuple(end)
