"""Hand-computed values on tiny inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import packet as P
from rfsense.functions import scalar as S
from rfsense.operators import calibrate as C
from rfsense.operators import recurrence as R
from rfsense.operators import spectral as X
from rfsense.operators import wavelet as V
from rfsense.operators import windows as W
from rfsense.operators.layout import arrange


def row(spark, **cols):
    return spark.range(1).select(*[F.expr(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in cols.items()]).first()


def ints(*v):
    return F.array(*[F.lit(int(x)) for x in v])


def doubles(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_packet_features(spark):
    ramp, flat = ints(*range(1, 9)), ints(*[5] * 8)
    zigzag = ints(1, 3, 2, 6, 4, 8, 5, 10)
    d = P.adjacent_diffs(zigzag)
    r = row(spark, var=P.pop_variance(ramp), var0=P.pop_variance(flat), ent=P.entropy(ramp), ent0=P.entropy(flat),
            iqr=P.iqr(ramp), iqr3=P.iqr(ints(1, 2, 3)), grad=P.mean(d), svar=P.pop_variance(d),
            corr=P.spatial_correlation(ramp), corr0=P.spatial_correlation(flat),
            one=P.mean(P.adjacent_diffs(ints(7))), amp=P.amplitudes(ints(3, 4, 6, 8)),
            std=P.array_stddev_pop(doubles(1, 2, 3, 4)), empty=P.entropy(F.expr("cast(array() as array<int>)")))
    assert r["var"] == pytest.approx(5.25) and r["var0"] == 0
    assert r["ent"] == pytest.approx(3.0) and r["ent0"] == pytest.approx(0.0)
    assert r["iqr"] == 4.0 and r["iqr3"] == 0.0  # sorted[6] - sorted[2]
    gaps = [2, 1, 4, 2, 4, 3, 5]
    assert r["grad"] == pytest.approx(np.mean(gaps)) and r["svar"] == pytest.approx(np.var(gaps))
    assert r["corr"] == pytest.approx(1.0) and r["corr0"] == 0.0 and r["one"] == 0.0
    assert r["amp"] == [5.0, 10.0] and r["std"] == pytest.approx(np.std([1, 2, 3, 4])) and r["empty"] == 0.0


def test_tinyint_values_do_not_overflow(spark):
    iq = F.expr("cast(array(127, -128, 127, -128, 127, -128, 127, -128, 127, -128) as array<tinyint>)")
    x = P.select_subcarriers(iq)
    r = row(spark, d=P.mean(P.adjacent_diffs(x)), v=P.pop_variance(x))
    assert r["d"] == 255.0 and r["v"] == pytest.approx(127.5**2)


def test_subcarrier_selection(spark):
    iq = F.sequence(F.lit(0), F.lit(127))
    r = row(spark, a=P.select_subcarriers(iq), b=P.select_subcarriers(F.slice(iq, 1, 118)), c=P.analysis_band(iq))
    assert r["a"] == list(range(94, 118))
    assert len(r["b"]) == 118  # 59 subcarriers are not more than 59
    assert r["c"] == list(range(12, 116))


def test_scalars(spark):
    r = row(spark, n1=S.normalise(F.lit(5.0), 0.0, 10.0), n2=S.normalise(F.lit(-5.0), 0.0, 10.0),
            n3=S.normalise(F.lit(5.0), 1.0, 1.0), s1=S.soft_threshold(F.lit(2.5), 1.0), s2=S.soft_threshold(F.lit(0.5), 1.0),
            s3=S.soft_threshold(F.lit(-2.5), 1.0), h1=S.hard_threshold(F.lit(2.5), 1.0), h2=S.hard_threshold(F.lit(0.5), 1.0),
            c1=S.confidence(F.lit(0.9), F.lit(0.5)), c2=S.confidence(F.lit(0.25), F.lit(0.5)), c3=S.confidence(F.lit(0.1), F.lit(0.0)),
            q=S.separation_quality(F.lit(2.0)), u=S.decode(F.lit(9), S.STATE_NAMES), f=S.finite(F.lit(float("nan"))),
            m=S.noise_sigma(doubles(-1, 2, -3, 4)), m0=S.noise_sigma(F.expr("cast(array() as array<double>)")),
            w=S.separation_warnings(F.lit(1.234)))
    assert (r["n1"], r["n2"], r["n3"]) == (0.5, 0.0, 0.0)
    assert (r["s1"], r["s2"], r["s3"], r["h1"], r["h2"]) == (1.5, 0.0, -1.5, 2.5, 0.0)
    assert r["c1"] == 1.0 and r["c2"] == pytest.approx(0.5, abs=1e-5) and r["c3"] == 1.0
    assert r["q"] == "good" and r["u"] == "UNKNOWN" and r["f"] is False
    assert r["m"] == pytest.approx(2.5 / 0.6745) and r["m0"] == 1.0
    assert r["w"] == ["Low separation ratio (1.23 < 2.0) - consider more intense movement"]


def series(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "device_id long, seq long, x double") \
        .withColumn("ts", F.timestamp_seconds("seq"))


def test_hampel_replaces_an_outlier(spark):
    lay = arrange(series(spark, [1, 1.1, 1, 0.9, 100]), before=4)
    out = [r.y for r in W.hampel(lay.df, "x", "y", lay).orderBy("seq").collect()]
    assert out[:2] == [1.0, 1.1] and out[-1] == pytest.approx(1.0)


def test_zero_spread_replaces_any_deviation(spark):
    lay = arrange(series(spark, [5, 5, 5, 5, 5.001]), before=4)
    assert W.hampel(lay.df, "x", "y", lay).orderBy("seq").collect()[-1].y == 5.0


def test_ewma_of_a_constant(spark):
    out = R.ewma(series(spark, [5.0] * 10), "x", alpha=0.1).orderBy("seq").collect()
    assert all(r.ewma_mean == pytest.approx(5.0) for r in out)
    assert [r.ewma_variance for r in out] == pytest.approx([0.9**i for i in range(10)])


def test_ewma_blocks_equal_the_recurrence():
    x = np.random.default_rng(1).normal(size=2000)
    m, v, got = x[0], 1.0, [(x[0], 1.0)]
    for s in x[1:]:
        d = s - m
        m += 0.02 * d
        v = 0.98 * v + 0.02 * d * (s - m)
        got.append((m, v))
    mean, var = R.ewma_mean_var(x, 0.02)
    assert np.allclose(mean, [g[0] for g in got], atol=1e-12) and np.allclose(var, [g[1] for g in got], atol=1e-12)


def test_impulse_response_equals_the_recurrence():
    x = np.random.default_rng(2).normal(size=1000) * 100
    y = np.zeros(1000)
    for i in range(1000):
        y[i] = sum(K.LOWPASS_B[j] * x[i - j] for j in range(5) if i >= j) - sum(
            K.LOWPASS_A[j] * y[i - j] for j in range(1, 5) if i >= j)
    assert np.abs(np.convolve(x, R.impulse_response())[:1000] - y).max() < 1e-9


def test_wavelet_transform():
    assert sum(K.DB4_LOW) == pytest.approx(math.sqrt(2), abs=1e-6) and sum(K.DB4_HIGH) == pytest.approx(0, abs=1e-6)
    x = np.random.default_rng(3).normal(size=(4, 64))
    assert np.allclose(V.denoise_rows(x, 3, 0.0, "soft", "adjoint"), x, atol=1e-9)
    for mode in ("adjoint", "as_coded"):
        flat = np.full((1, 32), 5.0)
        assert np.allclose(V.denoise_rows(flat, 2, 1.5, "soft", mode), flat, atol=1e-6)
    noisy = np.sin(2 * np.pi * np.arange(32) / 16)[None, :] + np.where(np.arange(32) % 2 == 0, 2.0, -2.0)
    assert np.var(V.denoise_rows(noisy, 2, 1.5, "soft", "adjoint")) < np.var(noisy)
    with pytest.raises(ValueError):
        V.matrices(32, 3)


def test_short_series_pass_the_sliding_wavelet(spark):
    vals = [math.sin(2 * math.pi * i / 16) + (0.3 if i % 5 == 0 else 0) for i in range(37)]
    lay = arrange(series(spark, vals), before=32)
    df = lay.df.withColumn("_p", lay.pos())
    out = [r.y for r in df.withColumn("y", V.sliding(F.col("x"), lay, F.col("_p"), 2, 0.5)).orderBy("seq").collect()]
    assert out[:32] == pytest.approx(vals[:32])
    assert out[32] == pytest.approx(V.denoise_rows(np.array([vals[1:33]]), 2, 0.5, "soft", "adjoint")[0, 16])


def test_power_iteration_matches_the_leading_eigenvalue():
    a = np.random.default_rng(4).normal(size=(200, 8)) * np.arange(1, 9)
    m = np.cov(a.T)
    value, v = X.power_iteration(m)
    assert value == pytest.approx(np.linalg.eigvalsh(m)[-1], rel=1e-4)
    assert np.linalg.norm(v) == pytest.approx(1.0)


def test_threshold_rules(spark):
    def t(b, m, sb, sm):
        lit = [F.lit(float(v)) for v in (b, m, sb, sm)]
        return C.threshold(*lit, lit[1] / lit[0])

    r = row(spark, plain=t(0.2, 0.6, 1, 1), low=t(0.2, 0.6, 1e9, 1e-9), none=t(0.2, 0.6, 0, 0), poor=t(0.5, 0.6, 1, 1),
            floor=t(0.01, 0.02, 1, 1))
    assert r["plain"] == pytest.approx(0.4 * 1.05)
    assert r["low"] == pytest.approx(0.2 + 0.4 * 0.7)
    assert r["none"] == pytest.approx(0.42)
    assert r["poor"] == pytest.approx(min(0.55 * 1.05, 0.57))
    assert r["floor"] == 0.15


def test_model_invariants(spark):
    from rfsense.operators.features import features
    from rfsense.plans.pipelines import calibrate
    from rfsense.sources import tables
    from tests.conftest import SF

    f = features(tables.packets(spark, SF))
    m = calibrate(f).model.groupBy("device_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert m and all(r.w == pytest.approx(1.0) and 4 <= r.n <= 6 for r in m)


def test_command_errors(spark):
    from rfsense.operators.control import validate

    rows = [('{"cmd":"threshold","value":0.5}', 0.5, None), ('{"cmd":"debounce","value":3.9}', 3.0, None),
            ('{"cmd":"debounce","value":0}', None, "ERROR: Debounce count must be between 1 and 10"),
            ('{"cmd":"threshold","value":"x"}', None, "ERROR: Missing or invalid 'value' field"),
            ('{"cmd":"threshold"}', None, "ERROR: Missing or invalid 'value' field"), ("{oops", None, "ERROR: Invalid JSON"),
            ('{"value":1}', None, "ERROR: Missing 'cmd' field"), ('{"cmd":"nope"}', None, "ERROR: Unknown command 'nope'"),
            ('{"cmd":"logs","enabled":false}', 0.0, None), ('{"cmd":"logs"}', None, "ERROR: Missing or invalid 'enabled' field"),
            ('{"cmd":"calibrate","action":"start","samples":100}', None, None),
            ('{"cmd":"calibrate","action":"x"}', None, "ERROR: Unknown calibration action 'x' (use: start, stop, status)")]
    got = {r.message: (r.setting, r.error) for r in validate(spark.createDataFrame(
        [(m,) for m, _, _ in rows], "message string")).collect()}
    assert got == {m: (s, e) for m, s, e in rows}
