"""Resets at ticks: the closed form against a clock that looks at every tick; sessions of hot devices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfsense.operators import control as M
from rfsense.operators import sessions as N
from rfsense.operators.ticks import TickClock, idle_resets
from rfsense.functions.scalar import round_exactly
from rfsense.sources import tables
from tests.conftest import SF


def fold(us, moving, timeout_ms, period_ms, upto):
    """The ticks with resets before tick ``upto``."""
    out, clock = [], None
    for k in range(-(-us[0] // (period_ms * 1000)), upto):
        seen = [m for t, m in zip(us, moving) if t <= k * period_ms * 1000]
        if seen[-1]:
            clock = k
        elif clock is not None and timeout_ms and (k - clock) * period_ms >= timeout_ms:
            out.append(k)
            clock = k
    return out


def random_rows(rng):
    n = rng.integers(1, 30)
    us = np.sort(rng.integers(0, 60_000_000, n)) if rng.random() < 0.5 else np.sort(rng.integers(0, 60, n)) * 1_000_000
    return us, rng.random(n) < 0.3


@pytest.mark.parametrize("seed", range(60))
def test_clock(seed):
    rng = np.random.default_rng(seed)
    us, moving = random_rows(rng)
    timeout, period = int(rng.integers(0, 9000)), int(rng.choice([500, 1000, 2500]))
    clock, state, got = TickClock(timeout, period), (None, False, None, 0), []
    for part in np.array_split(np.arange(len(us)), rng.integers(1, 6)):
        if len(part):
            ticks, state = clock.walk(us[part], moving[part], state)
            got += ticks.tolist()
            if rng.random() < 0.5:  # silence up to the next row
                upto = int(us[min(part[-1] + 1, len(us) - 1)] // (period * 1000))
                ticks, state = clock.until(upto, state)
                got += ticks.tolist()
    soon = clock.next(state)
    ticks, state = clock.until(200, state)
    assert soon is None or soon >= 200 or soon == ticks[0]
    got += ticks.tolist()
    assert got == fold(us.tolist(), moving.tolist(), timeout, period, 200) and state[3] == len(got)


@pytest.mark.parametrize("hot", [False, True])
def test_batch(spark, hot, request):
    if hot:
        request.getfixturevalue("small_pieces")
    rng = np.random.default_rng(5)
    rows = []
    for device in range(4):
        us, moving = np.sort(rng.integers(0, 400_000_000, 300)), rng.random(300) < 0.1
        rows += [(device, int(t), i, "DETECTED" if m else "IDLE") for i, (t, m) in enumerate(zip(us, moving))]
    states = spark.createDataFrame(rows, "device_id long, us long, seq long, state string").withColumn("ts", F.timestamp_micros("us")).repartition(3)
    got = {(r.device_id, r.seq): (r.epoch, r.resets) for r in idle_resets(states, 7, 1).collect()}
    for device in range(4):
        own = [r for r in rows if r[0] == device]
        at = fold([r[1] for r in own], [r[3] != "IDLE" for r in own], 7000, 1000, -(-own[-1][1] // 1_000_000))
        assert [got[device, r[2]][0] for r in own] == [sum(k * 1_000_000 < r[1] for k in at) for r in own]
        assert sum(got[device, r[2]][1] for r in own) == len(at) > 3


def test_disabled(spark):
    states = spark.createDataFrame([(1, 0, 1, "DETECTED"), (1, 90, 2, "IDLE"), (1, 900, 3, "IDLE")], "device_id long, s long, seq long, state string").withColumn("ts", F.timestamp_seconds("s"))
    assert idle_resets(states, 0).agg(F.max("epoch"), F.sum("resets")).first() == (0, 0)
    assert TickClock(0, 1000).next((5, False, 3, 0)) is None


def test_sessions_of_hot_devices(spark, small_pieces):
    packets, messages = tables.packets(spark, SF), M.validate(tables.calibration_commands(spark, SF))
    hot = sorted(map(tuple, N.sessions(packets, messages).collect()))
    plain = sorted(map(tuple, N.sessions(packets, messages, piece_rows=10**6).collect()))
    assert hot == plain and len({r[3] for r in hot}) > 1
    assert sorted(map(tuple, N.calls(packets, messages).collect())) == sorted(map(tuple, N.calls(packets, messages, piece_rows=10**6).collect()))


def test_answers(spark):
    texts = [("threshold", 0.3), ("threshold", 0.45), ("wavelet_level", 2), ("wavelet_level", 3), ("traffic_generator_rate", 0), ("traffic_generator_rate", 15), ("traffic_generator_rate", 30),
             ("adaptive_normalizer_alpha", 0.01), ("adaptive_normalizer_reset_timeout", 0), ("adaptive_normalizer_reset_timeout", 90), ("hampel_threshold", 3.25)]
    log = [(1, i, '{"cmd":"%s","value":%s}' % c) for i, c in enumerate(texts)] + [(1, 50, '{"cmd":"factory_reset"}'), (1, 51, '{"cmd":"threshold","value":0.2}'), (1, 52, '{"cmd":"wavelet_filter","enabled":true}'),
                                                                             (1, 53, "{oops"), (1, 54, '{"cmd":"stats"}')]
    messages = spark.createDataFrame(log, "device_id long, seq long, message string").withColumn("ts", F.timestamp_seconds("seq"))
    assert [r.answer for r in N.answers(M.validate(messages)).orderBy("seq").collect()] == [
        "Threshold updated: 0.5000 -> 0.3000", "Threshold updated: 0.3000 -> 0.4500", "Wavelet decomposition level updated: 3 -> 2 (denoising less aggressive)",
        "Wavelet decomposition level updated: 2 -> 3 (denoising more aggressive)", "Traffic generator disabled (was 20 pps)", "Traffic generator enabled (15 pps)", "Traffic rate updated: 15 -> 30 pps",
        "Adaptive normalizer alpha updated: 0.0200 -> 0.0100 (learning rate decreased)", "Adaptive normalizer auto-reset disabled (was 60 sec)", "Adaptive normalizer reset timeout updated: 0 -> 90 seconds",
        "Hampel threshold updated: 2.0 -> 3.2", "✅ Factory reset complete - all settings restored to defaults", "Threshold updated: 0.5000 -> 0.2000", "Wavelet filter enabled", "ERROR: Invalid JSON"]


def test_rounding_is_that_of_c(spark):
    values = [k / 80 for k in range(1, 80)] + [k / 1000 for k in range(1, 300)] + [2.675, 1.005, 0.125, 0.375]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(F.format_string("%.2f", round_exactly(F.col("v"), 2))).collect()
    assert [r[0] for r in got] == ["%.2f" % v for v in values]
