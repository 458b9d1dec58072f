"""Calibration sessions: ``calibrate`` commands and packets of a device on one time line.

A session begins with an accepted ``start`` and takes the next ``samples`` packets as BASELINE and as many again as MOVEMENT; it ends with the last of
them, or earlier with a ``stop``. While one runs, or with a number of samples out of range, a start is refused. Packets are counted before each
command by window sums; then only a device's commands are gone through in order, and every packet finds its session as of its time.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import scalar as S
from rfsense.operators.layout import arrange
from rfsense.operators.walk import Columns, walk

START = "session long, target long, before long"


def _line(packets: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (kind 0) come before packets (kind 1) of their time."""
    calls = commands.where((F.col("kind") == "action") & F.col("accepted"))
    return packets.select("device_id", "ts", "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("long").alias("samples"), F.lit(None).cast("boolean").alias("verbose")).unionByName(
        calls.select("device_id", "ts", "seq", F.lit(0).alias("kind"), "action", F.col("samples").cast("long").alias("samples"), F.col("verbose").cast("boolean").alias("verbose")))


def phase_at(n: int, target: int) -> tuple[str, int]:
    """The phase once ``n`` packets of a session came, and how many of them are the phase's own."""
    if target <= 0 or n >= 2 * target:
        return "IDLE", 0
    return ("BASELINE", n) if n < target else ("MOVEMENT", n - target)


class _Calls:
    """A device's calls in order; state: session, samples of the running one (0: none), packets before it."""

    def __init__(self, default_samples: int, rate: int):
        self.default, self.rate = default_samples, rate

    def __call__(self, c: Columns, state: tuple | None) -> tuple[Columns, tuple]:
        session, target, start = state or (0, 0, 0)
        names = ("session", "target", "before", "taken", "phase", "response")
        out: dict[str, list] = {n: [] for n in names}
        for action, samples, verbose, before in zip(c["action"], c["samples"], c["verbose"], c["before"], strict=True):
            before, taken = int(before), True
            running = target > 0 and before - start < 2 * target
            # The answers.
            if action == "start":
                n = self.default if samples is None or samples != samples else int(samples)
                taken = not running and K.CALIBRATION_SAMPLES[0] <= n <= K.CALIBRATION_SAMPLES[1]
                text = "ERROR: Failed to start calibration (already in progress?)"
                if taken:
                    session, target, start = session + 1, n, before
                    text = f"Calibration started ({n} samples per phase" + (", CSI raw logging enabled)" if verbose else ")")
            elif action == "stop":
                target, text = 0, "Calibration stopped"
            else:
                text = json.dumps(self.status(before - start, target), separators=(",", ":"))
            for n, v in zip(names, (session, target, start, taken, phase_at(before - start, target)[0], text), strict=True):
                out[n].append(v)
        return {**{k: c[k] for k in ("device_id", "ts", "seq", "action")}, **{n: np.array(v, object) for n, v in out.items()}}, (session, target, start)

    def status(self, n: int, target: int) -> dict:
        phase, own = phase_at(n, target)
        doc: dict = {"phase": phase, "active": phase != "IDLE"}
        if phase != "IDLE":
            doc |= {"samples_collected": own, "samples_target": target}
            if self.rate > 0 and target > own:
                doc["estimated_time_remaining_sec"] = (target - own) // self.rate
        return doc


def calls(packets: DataFrame, commands: DataFrame, default_samples: int = 1000, rate: int = 20, piece_rows: int | None = None) -> DataFrame:
    """Every accepted ``calibrate`` command in effect: its ``session`` so far, ``target`` samples of the running one (0: none), packets ``before`` it
    began, whether it was ``taken``, the ``phase`` after it, and the ``response``.

    ``commands``: validated messages. ``rate``: packets a second, for the time that a status estimates.
    """
    line = _line(packets, commands)
    lay = arrange(line, order=("ts", "kind", "seq"), piece_rows=piece_rows)
    counted = lay.done(lay.sum_before(lay.df.withColumn("_one", F.col("kind").cast("long")), "_one", "before"))
    own = counted.where("kind = 0")
    device = own.schema["device_id"].dataType.simpleString()
    return walk(own, ["device_id"], ["ts", "seq"], ["device_id", "ts", "seq", "action", "samples", "verbose", "before"], _Calls(default_samples, rate),
                f"device_id {device}, ts timestamp, seq long, action string, session long, target long, before long, taken boolean, phase string, response string")


def sessions(packets: DataFrame, commands: DataFrame, default_samples: int = 1000, piece_rows: int | None = None) -> DataFrame:
    """The packets that a session took: ``session``, ``phase``, ``sample_in_phase``."""
    turned = calls(packets, commands, default_samples, piece_rows=piece_rows).where((F.col("action") == "stop") | (F.col("action") == "start") & F.col("taken"))
    now = F.struct("session", "target", "before")
    both = packets.select("device_id", "ts", "seq", F.lit(1).alias("kind"), F.lit(None).cast(f"struct<{', '.join(f.replace(' ', ':') for f in START.split(', '))}>").alias("turn")).unionByName(
        turned.select("device_id", "ts", "seq", F.lit(0).alias("kind"), now.alias("turn")))
    lay = arrange(both, order=("ts", "kind", "seq"), piece_rows=piece_rows)
    df = lay.sum_before(lay.df.withColumn("_one", F.col("kind").cast("long")), "_one", "_n")
    df = lay.done(lay.carry(df, {"_now": F.col("turn")})).where("kind = 1")
    n, target = F.col("_n") - F.col("_now.before"), F.col("_now.target")
    return df.where((target > 0) & (n < 2 * target)).select(
        "device_id", "ts", "seq", F.col("_now.session").alias("session"), F.when(n < target, "BASELINE").otherwise("MOVEMENT").alias("phase"),
        (n % target + 1).alias("sample_in_phase"))


def answer(cmd: Column, old: Column, new: Column) -> Column:
    """What an accepted setting is answered with. The texts."""
    def moved(text: str) -> Column:
        digits = int(text.rsplit("%.", 1)[1][0])
        return F.format_string(text, S.round_exactly(old, digits), S.round_exactly(new, digits))

    def whole(text: str) -> Column:
        return F.format_string(text, old.cast("long"), new.cast("long"))

    def turned(name: str) -> Column:
        return F.concat(F.lit(name + " "), F.when(new != 0, "enabled").otherwise("disabled"))

    def more(text: str, up: str, down: str, kind=moved) -> Column:
        return F.concat(kind(text), F.lit(" ("), F.when(new > old, up).otherwise(down), F.lit(")"))

    texts = {
        "threshold": moved("Threshold updated: %.4f -> %.4f"),
        "persistence": whole("Persistence timeout updated: %d -> %d seconds"),
        "debounce": whole("Debounce count updated: %d -> %d"),
        "hysteresis": moved("Hysteresis ratio updated: %.2f -> %.2f"),
        "logs": turned("CSI logs"),
        "hampel_filter": turned("Hampel filter"),
        "hampel_threshold": moved("Hampel threshold updated: %.1f -> %.1f"),
        "savgol_filter": turned("Savitzky-Golay filter"),
        "butterworth_filter": turned("Butterworth filter"),
        "wavelet_filter": turned("Wavelet filter"),
        "wavelet_level": more("Wavelet decomposition level updated: %d -> %d", "denoising more aggressive", "denoising less aggressive", whole),
        "wavelet_threshold": more("Wavelet threshold updated: %.2f -> %.2f", "noise removal more aggressive", "noise removal less aggressive"),
        "smart_publishing": turned("Smart publishing"),
        "adaptive_normalizer": turned("Adaptive normalizer"),
        "adaptive_normalizer_alpha": more("Adaptive normalizer alpha updated: %.4f -> %.4f", "learning rate increased", "learning rate decreased"),
        "adaptive_normalizer_reset_timeout": F.when(new == 0, F.format_string("Adaptive normalizer auto-reset disabled (was %d sec)", old.cast("long")))
        .otherwise(whole("Adaptive normalizer reset timeout updated: %d -> %d seconds")),
        "traffic_generator_rate": F.when(new == 0, F.format_string("Traffic generator disabled (was %d pps)", old.cast("long")))
        .when(old == 0, F.format_string("Traffic generator enabled (%d pps)", new.cast("long"))).otherwise(whole("Traffic rate updated: %d -> %d pps")),
        "factory_reset": F.lit("✅ Factory reset complete - all settings restored to defaults"),
    }
    out = F.lit(None).cast("string")
    for name, text in reversed(texts.items()):
        out = F.when(cmd == name, text).otherwise(out)
    return out


def answers(validated: DataFrame, piece_rows: int | None = None) -> DataFrame:
    """The answer to every message that is no report or ``calibrate`` call: the error, or what changed from which value to which.

    The value before a setting is the device's last accepted one of that command, or the default, also after a factory reset.
    """
    known = F.create_map(*[F.lit(x) for cmd, (_, default) in K.CONFIG_DEFAULTS.items() for x in (cmd, default)])
    sets = validated.where(~F.coalesce(F.col("accepted") & F.col("kind").isin("report", "action"), F.lit(False)))
    # One row for each setting of a device; a reset counts for all of them, so it is a setting of each.
    resets = validated.where(F.col("accepted") & (F.col("kind") == "reset")).select("device_id", "ts", "seq", F.explode(F.map_keys(known)).alias("name"), F.lit(True).alias("reset"))
    own = sets.where(F.col("accepted") & F.col("setting").isNotNull()).select("device_id", "ts", "seq", F.col("cmd").alias("name"), F.lit(False).alias("reset"), "setting")
    line = own.unionByName(resets, allowMissingColumns=True)
    lay = arrange(line, keys=("device_id", "name"), piece_rows=piece_rows)
    value = F.when(F.col("reset"), F.try_element_at(known, F.col("name"))).otherwise(F.col("setting"))
    changed = lay.done(lay.carry(lay.df, {"_old": value}, inclusive=False)).where(~F.col("reset"))
    changed = changed.select("device_id", "ts", "seq", F.coalesce("_old", F.try_element_at(known, F.col("name"))).alias("old"))
    out = sets.join(changed, ["device_id", "ts", "seq"], "left")
    return out.select(*sets.columns, "old", F.coalesce("error", answer(F.col("cmd"), F.col("old"), F.col("setting"))).alias("answer"))
