"""Subcarrier statistics, covariance, principal components, Doppler features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import kernels as Q
from rfsense.operators.layout import arrange


def subcarriers(packets: DataFrame) -> DataFrame:
    """One row per packet and subcarrier with its amplitude."""
    amps = packets.select("device_id", "phase", "seq", Q.amplitude_array(F.col("iq").cast("array<int>")).alias("a"))
    return amps.select("device_id", "phase", "seq", F.posexplode("a").alias("sc", "amp"))


def subcarrier_fisher(packets: DataFrame) -> DataFrame:
    """Per subcarrier: phase means and variances, Fisher score, variance ratio, mean difference, rank."""
    def of(phase: str) -> Column:
        return F.when(F.col("phase") == phase, F.col("amp"))

    s = subcarriers(packets).groupBy("device_id", "sc").agg(
        F.avg(of("BASELINE")).alias("baseline_mean"), F.avg(of("MOVEMENT")).alias("movement_mean"),
        F.var_pop(of("BASELINE")).alias("baseline_var"), F.var_pop(of("MOVEMENT")).alias("movement_var"))
    d, v = F.abs(F.col("movement_mean") - F.col("baseline_mean")), F.col("baseline_var") + F.col("movement_var")
    scored = s.select(
        "*", F.when(v > K.EPS, d * d / v).otherwise(0.0).alias("fisher"),
        F.when(F.col("baseline_var") > K.EPS, F.col("movement_var") / F.col("baseline_var")).otherwise(1.0)
        .alias("variance_ratio"), d.alias("mean_diff"))
    return scored.withColumn("rank", F.row_number().over(
        Window.partitionBy("device_id").orderBy(F.desc("fisher"), "sc")))


def zone_fisher(scored: DataFrame, edges: tuple[int, int] = (10, 55)) -> DataFrame:
    """Total and mean Fisher of the edge and middle zones, and their share of all subcarriers'."""
    zone = F.when(F.col("sc") < edges[0], "low").when(F.col("sc") < edges[1], "middle").otherwise("high")
    z = scored.groupBy("device_id", zone.alias("zone")).agg(
        F.count(F.lit(1)).alias("subcarriers"), F.sum("fisher").alias("total_fisher"), F.avg("fisher").alias("avg_fisher"))
    dev = Window.partitionBy("device_id")
    all_total = F.sum("total_fisher").over(dev)
    all_avg = all_total / F.sum("subcarriers").over(dev)
    return z.withColumn("total_pct", F.when(all_total > 0, F.col("total_fisher") / all_total * 100).otherwise(0.0)) \
        .withColumn("avg_pct", F.when(all_avg > 0, F.col("avg_fisher") / all_avg * 100).otherwise(0.0))


def best_range(scored: DataFrame, widths: tuple[int, ...] = (30, 35, 40, 45, 50)) -> DataFrame:
    """Contiguous subcarrier range with the highest mean Fisher; the first wins on ties."""
    dev = Window.partitionBy("device_id").orderBy("sc")
    df = scored.select("device_id", "sc", "fisher")
    tries = []
    for w in widths:
        ahead = dev.rowsBetween(0, w - 1)
        avg = F.when(F.count("fisher").over(ahead) == w, F.avg("fisher").over(ahead))
        df = df.withColumn(f"_a{w}", avg)
        tries.append(F.struct(F.lit(w).alias("width"), F.col(f"_a{w}").alias("avg")))
    flat = df.select("device_id", "sc", F.inline(F.array(*tries))).where(F.col("avg") > 0)
    # Averages equal up to rounding count as ties.
    top = F.max("avg").over(Window.partitionBy("device_id"))
    return (
        flat.withColumn("_top", top).where(F.col("avg") >= F.col("_top") * (1 - 1e-12))
        .groupBy("device_id").agg(F.min_by(F.struct("sc", "width", "avg"), F.struct("width", "sc")).alias("b"))
        .select("device_id", F.col("b.sc").alias("range_start"), (F.col("b.sc") + F.col("b.width")).alias("range_end"),
                F.col("b.avg").alias("avg_fisher"))
    )


MAX_OPEN = 256


Moments = tuple[int, np.ndarray, np.ndarray]  # count, means, centred products


def _moments(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    return len(x), mean, (x - mean).T @ (x - mean)


def _merged(p: Moments, q: Moments) -> Moments:
    n, d = p[0] + q[0], q[1] - p[1]
    return n, p[1] + d * (q[0] / n), p[2] + q[2] + np.outer(d, d) * (p[0] * q[0] / n)


def pair_covariance(packets: DataFrame, phase: str = "MOVEMENT") -> DataFrame:
    """Sample covariance of subcarrier amplitudes, entries i <= j, per device, and the number of packets behind each.

    A packet counts for every pair of subcarriers it has, whatever its length; empty packets have none. Every task
    keeps count, means and centred products per device and packet length in one pass, and only these travel. What the
    means of different tasks differ by is added as plain sums, which is exact enough for amplitudes of a fixed range.
    """
    rows = packets.where(F.col("phase") == phase).select(
        F.col("device_id").alias("d"), Q.amplitude_array(F.col("iq").cast("array<int>")).alias("a")).where(F.size("a") > 0)

    def flush(acc: dict, key: pa.DataType) -> pa.RecordBatch:
        out = [(d, i, float(n), mean[i], mean[i:], m[i, i:]) for (d, _), (n, mean, m) in acc.items() for i in range(len(mean))]
        doubles = pa.list_(pa.float64())
        types = (key, pa.int32(), pa.float64(), pa.float64(), doubles, doubles)
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["d", "i", "n", "mi", "means", "sums"])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.schema.field("d").type
            ids, a = batch.column("d").dictionary_encode(null_encoding="encode"), batch.column("a")
            codes, devices = ids.indices.to_numpy(zero_copy_only=False), ids.dictionary.to_pylist()
            offsets, flat = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            order = np.lexsort((lengths, codes))
            new = (np.diff(codes[order]) != 0) | (np.diff(lengths[order]) != 0)
            for same in np.split(order, np.flatnonzero(new) + 1):
                group, n = (devices[codes[same[0]]], int(lengths[same[0]])), int(lengths[same[0]])
                now = _moments(flat[offsets[same][:, None] + np.arange(n)])
                acc[group] = _merged(acc[group], now) if group in acc else now
            if len(acc) > MAX_OPEN:
                yield flush(acc, key)
                acc = {}
        if acc:
            yield flush(acc, key)

    kind = rows.schema["d"].dataType.simpleString()
    parts = rows.mapInArrow(gram, f"d {kind}, i int, n double, mi double, means array<double>, sums array<double>")
    each = parts.select("d", "i", "n", "mi", F.posexplode(F.arrays_zip("means", "sums")).alias("k", "p"))
    n, x, y = F.col("n"), F.col("mi"), F.col("p.means")
    total = each.groupBy(F.col("d").alias("device_id"), "i", (F.col("i") + F.col("k")).alias("j")).agg(
        F.sum(n).alias("n"), F.sum("p.sums").alias("_in"), F.sum(n * x).alias("_x"), F.sum(n * y).alias("_y"),
        F.sum(n * x * y).alias("_xy"))
    between = F.col("_xy") - F.col("_x") * F.col("_y") / n
    return total.where(n > 1).select("device_id", "i", "j", ((F.col("_in") + between) / (n - 1)).alias("cov"),
                                     n.cast("long").alias("packets"))


def covariance(packets: DataFrame, phase: str = "MOVEMENT") -> DataFrame:
    """Sample covariance of subcarrier amplitudes, entries i <= j, per device."""
    return pair_covariance(packets, phase).drop("packets")


def power_iteration(m: np.ndarray, iterations: int = 50) -> tuple[float, np.ndarray]:
    v = np.full(len(m), 1.0 / np.sqrt(len(m)))
    value = 0.0
    for _ in range(iterations):
        u = m @ v
        value = float(v @ u / (v @ v))
        norm = float(np.linalg.norm(u))
        if norm < 1e-10:
            break
        v = u / norm
    return value, v


def pca(cov: DataFrame, components: int = 6) -> DataFrame:
    """Leading components of each device's covariance: eigenvalue, shares, loadings.

    ``components_for_95`` counts the components whose cumulative share is still below 95 %.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["j"].max()) + 1
        m = np.zeros((n, n))
        m[pdf["i"], pdf["j"]] = pdf["cov"]
        m[pdf["j"], pdf["i"]] = pdf["cov"]
        trace, cum, below, out = float(np.trace(m)), 0.0, 0, []
        for c in range(min(components, n)):
            value, v = power_iteration(m)
            m = m - value * np.outer(v, v)
            pct = value / trace * 100.0 if trace else 0.0
            cum += pct
            below = c + 1 if cum < 95.0 else below
            out.append((pdf["device_id"].iloc[0], c + 1, value, pct, cum, v.tolist()))
        res = pd.DataFrame(out, columns=["device_id", "pc", "eigenvalue", "explained_pct", "cumulative_pct", "loadings"])
        return res.assign(components_for_95=below)

    key = cov.schema["device_id"].dataType.simpleString()
    return cov.groupBy("device_id").applyInPandas(
        solve, f"device_id {key}, pc int, eigenvalue double, explained_pct double, cumulative_pct double, "
               "loadings array<double>, components_for_95 int")


def top_loadings(components: DataFrame, n: int = 3) -> DataFrame:
    rows = components.select("device_id", "pc", F.posexplode("loadings").alias("sc", "w"))
    w = Window.partitionBy("device_id", "pc").orderBy(F.desc(F.abs("w")), "sc")
    return rows.select("device_id", "pc", F.row_number().over(w).alias("rank"), "sc",
                       F.abs("w").alias("weight")).where(F.col("rank") <= n)


def _spectrum(frames: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    n = frames.shape[1]
    hann = 0.5 * (1.0 - np.cos(2.0 * np.pi * np.arange(n) / (n - 1)))
    mag = np.abs(np.fft.rfft(frames * hann, axis=1)[:, : n // 2])
    df = rate / n
    f = np.arange(n // 2) * df
    total, peak = mag.sum(axis=1), mag.max(axis=1)
    safe = np.where(total < K.EPS, 1.0, total)
    centroid = mag @ f / safe
    spread = (mag > peak[:, None] * 0.1).sum(axis=1) * df
    rms = np.sqrt((mag * (f[None, :] - centroid[:, None]) ** 2).sum(axis=1) / safe)
    return {"doppler_spread": spread, "rms_doppler_spread": rms, "peak_doppler": peak,
            "spectral_centroid": centroid, "total": total}


def doppler_frames(samples: DataFrame, x: str, keys: tuple[str, ...] = ("device_id", "phase"),
                   size: int = K.DOPPLER_ROWS, hop: int = K.DOPPLER_HOP, piece_rows: int | None = None) -> DataFrame:
    """Trailing frames ending at positions size-1 or later that are multiples of ``hop``, and at the last row."""
    lay = arrange(samples, before=size - 1, keys=keys, piece_rows=piece_rows)
    p = F.col("frame_end")
    df = lay.df.withColumn("frame_end", lay.pos()).withColumn("_n", lay.total())
    df = df.withColumn("frame", F.collect_list(x).over(lay.last_n(size)))
    emit = (p >= size - 1) & ((p % hop == 0) | (p == F.col("_n") - 1))
    return lay.done(df).where(emit).select(*keys, "frame_end", "frame")


def doppler_features(frames: DataFrame, keys: tuple[str, ...] = ("device_id", "phase"),
                     size: int = K.DOPPLER_ROWS, rate: float = K.DOPPLER_RATE) -> DataFrame:
    """Spectral spread, RMS spread, peak and centroid of every frame; frames without power are dropped."""
    ddl = "doppler_spread double, rms_doppler_spread double, peak_doppler double, spectral_centroid double, total double"

    @F.arrow_udf(f"struct<{ddl.replace(' double', ':double')}>")
    def spectrum(a: pa.Array) -> pa.Array:
        x = a.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        s = _spectrum(x, rate)
        return pa.StructArray.from_arrays([pa.array(v, type=pa.float64()) for v in s.values()], names=list(s))

    return (
        frames.withColumn("_s", spectrum(F.col("frame"))).where(F.col("_s.total") >= K.EPS)
        .select(*keys, "frame_end", *[F.col(f"_s.{n}").alias(n) for n in K.DOPPLER_FEATURES])
    )
