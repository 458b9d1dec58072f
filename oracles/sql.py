"""The named queries in plain SQL, written from the operator definitions.

Path-dependent operators are row-by-row folds here, where the Spark side works on runs,
pieces and windows.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Feature names, default weights and ranges, filter coefficients, wavelet taps.
FEATURES = (
    "variance", "skewness", "kurtosis", "entropy", "iqr",
    "spatial_variance", "spatial_correlation", "spatial_gradient",
    "temporal_delta_mean", "temporal_delta_variance",
)
WEIGHTS = (0.128, 0.111, 0.166, 0.0, 0.182, 0.0, 0.0, 0.171, 0.241, 0.0)
RANGES = ((0, 800), (-2.5, 1.5), (-3, 6), (4, 7), (0, 50), (0, 400), (-1, 1), (0, 40), (0, 20), (0, 150))
DOPPLER = ("doppler_spread", "rms_doppler_spread", "peak_doppler", "spectral_centroid")
B_LP = (0.00482434, 0.01929736, 0.02894604, 0.01929736, 0.00482434)
A_LP = (1.0, -2.36951301, 2.31398841, -1.05466541, 0.18737949)
SG = (-0.0857, 0.3429, 0.4857, 0.3429, -0.0857)
DB4_LOW = (-0.010597401785, 0.032883011667, 0.030841381836, -0.187034811719,
           -0.027983769417, 0.630880767930, 0.714846570553, 0.230377813309)
DB4_HIGH = (-0.230377813309, 0.714846570553, -0.630880767930, -0.027983769417,
            0.187034811719, 0.030841381836, -0.032883011667, -0.010597401785)
DB4_SYN_LOW = (0.230377813309, 0.714846570553, 0.630880767930, -0.027983769417,
               -0.187034811719, 0.030841381836, 0.032883011667, -0.010597401785)
DB4_SYN_HIGH = (-0.010597401785, -0.032883011667, 0.030841381836, 0.187034811719,
                -0.027983769417, -0.630880767930, 0.714846570553, -0.230377813309)
H = 3600


def dbl(values) -> str:
    return "[" + ", ".join(f"{v!r}" for v in values) + "]::DOUBLE[]"


def add(name: str, ctes: list[str], body: str, doubles: str = "", recursive: bool = False) -> None:
    """Register ``body`` after ``ctes`` with the named double columns rounded to six digits."""
    repl = ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in doubles.split())
    star = f"* REPLACE ({repl})" if repl else "*"
    chain = ",\n".join([*dict.fromkeys(ctes), f"result_ AS ({body})"])
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{chain}\nSELECT {star} FROM result_"


# --- views -------------------------------------------------------------------------------

PACKETS = """packets AS MATERIALIZED (
  SELECT (CASE WHEN vec_id % 10 < 5 THEN 0 WHEN vec_id % 10 < 8 THEN 1 ELSE 2 END)::BIGINT AS device_id,
         vec_id AS seq, TIMESTAMP '2024-01-01' + to_microseconds(vec_id * 50000) AS ts,
         CASE WHEN label < 5 THEN 'BASELINE' ELSE 'MOVEMENT' END AS phase,
         list_transform(embedding, lambda e: round(e::DOUBLE * 127)::INTEGER) AS iq
  FROM embeddings)"""
MIXED = """mixed AS (
  SELECT * REPLACE (iq[1:(CASE WHEN seq % 7 = 3 THEN 40 WHEN seq % 11 = 5 THEN 8 ELSE 64 END)] AS iq) FROM packets)"""
SERIES = """series AS MATERIALIZED (
  SELECT user_id AS device_id, event_id AS seq, ts, value AS x, least(1.0, value / 200) AS score FROM events)"""
W = "PARTITION BY device_id ORDER BY ts, seq"


def amps(x: str) -> str:
    return f"list_transform(range(0, len({x}) // 2), lambda k: sqrt({x}[2*k+1]*{x}[2*k+1] + {x}[2*k+2]*{x}[2*k+2]))"


def selected(src: str, start: int = 47, end: int = 59) -> str:
    return f"""sel AS (SELECT device_id, seq, ts, phase,
    CASE WHEN len(iq) // 2 > {end} THEN iq[{2 * start + 1}:{2 * end}] ELSE iq END AS x FROM {src} WHERE len(iq) >= 10)"""


STATIC = f"""static AS MATERIALIZED (
  SELECT *, list_var_pop(x) AS variance, list_entropy(x) AS entropy,
    CASE WHEN len(x) < 4 THEN 0.0 ELSE (list_sort(x)[3*len(x)//4 + 1] - list_sort(x)[len(x)//4 + 1])::DOUBLE END AS iqr,
    list_var_pop(d) AS spatial_variance, list_avg(d) AS spatial_gradient,
    CASE WHEN sqrt(ta * tb) < 1e-6 THEN 0.0 ELSE num / sqrt(ta * tb) END AS spatial_correlation,
    list_avg({amps('x')}) AS amp
  FROM (SELECT *, n * list_sum(list_transform(range(1, n + 1), lambda i: x[i] * x[i+1])) - list_sum(a) * list_sum(b) AS num,
      greatest(0, n * list_sum(list_transform(a, lambda v: v * v)) - list_sum(a) * list_sum(a))::DOUBLE AS ta,
      greatest(0, n * list_sum(list_transform(b, lambda v: v * v)) - list_sum(b) * list_sum(b))::DOUBLE AS tb
    FROM (SELECT *, len(x) - 1 AS n, x[1:len(x)-1] AS a, x[2:] AS b,
        list_transform(range(1, len(x)), lambda i: abs(x[i+1] - x[i])) AS d FROM sel)))"""
FEATS = f"""feats AS MATERIALIZED (
  SELECT device_id, seq, ts, phase, variance,
    CASE WHEN len(wl) < 3 OR list_stddev_pop(wl) < 1e-6 THEN 0.0
         ELSE list_avg(list_transform(wl, lambda v: pow(v - list_avg(wl), 3))) / pow(list_stddev_pop(wl), 3) END AS skewness,
    CASE WHEN len(wl) < 4 OR list_var_pop(wl) < 1e-6 THEN 0.0
         ELSE list_avg(list_transform(wl, lambda v: pow(v - list_avg(wl), 4))) / pow(list_var_pop(wl), 2) - 3 END AS kurtosis,
    entropy, iqr, spatial_variance, spatial_correlation, spatial_gradient,
    coalesce(list_avg(dd), 0.0) AS temporal_delta_mean, coalesce(list_var_pop(dd), 0.0) AS temporal_delta_variance
  FROM (SELECT *, list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - p[i])) AS dd
    FROM (SELECT *, CASE WHEN len(x) = fl THEN lag(x) OVER (PARTITION BY device_id, len(x) = fl ORDER BY ts, seq) END AS p
      FROM (SELECT *, list(amp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS wl,
          first_value(len(x)) OVER ({W}) AS fl FROM static))))"""
BASE = [PACKETS, selected("packets"), STATIC, FEATS]


def norm(v: str, lo, hi) -> str:
    return (f"(CASE WHEN ({hi}) - ({lo}) < 1e-6 THEN 0.0 "
            f"ELSE greatest(0.0, least(1.0, ({v} - ({lo})) / (({hi}) - ({lo})))) END)")


DEFAULT_SCORE = " + ".join(f"{w} * {norm(f, lo, hi)}" for f, w, (lo, hi) in zip(FEATURES, WEIGHTS, RANGES))
SCORED = f"scored AS MATERIALIZED (SELECT *, {DEFAULT_SCORE} AS score FROM feats)"
LONG = "flong AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT device_id, seq, ts, phase, {i} AS feature_idx, '{f}' AS feature, {f}::DOUBLE AS value FROM feats"
    for i, f in enumerate(FEATURES)) + ")"

STAT = "variance entropy iqr spatial_variance spatial_correlation spatial_gradient"
add("packet_features", [PACKETS, MIXED, selected("mixed"), STATIC],
    f"SELECT device_id, seq, {STAT.replace(' ', ', ')} FROM static", STAT)
ORACLES["packet_expressions"] = ORACLES["packet_features"]
add("packet_features_band", [PACKETS, selected("packets", 20, 30), STATIC],
    "SELECT device_id, seq, variance, iqr, spatial_gradient FROM static", "variance iqr spatial_gradient")
add("packet_amplitudes", [PACKETS],
    f"SELECT device_id, seq, list_avg({amps('iq')}) AS mean_amplitude, list_stddev_pop({amps('band')}) AS spatial_turbulence, "
    "len(band)::INTEGER AS band_values FROM (SELECT *, iq[13:116] AS band FROM packets)", "mean_amplitude spatial_turbulence")
add("subcarrier_amplitudes", [PACKETS],
    f"SELECT device_id, phase, seq, (unnest(range(0, len(iq) // 2)))::INTEGER AS sc, unnest({amps('iq')}) AS amp FROM packets", "amp")
DELTA = "temporal_delta_mean temporal_delta_variance"
add("temporal_deltas", BASE, "SELECT device_id, seq, temporal_delta_mean, temporal_delta_variance FROM feats", DELTA)
add("temporal_deltas_mixed", [PACKETS, MIXED, selected("mixed"), STATIC, FEATS],
    "SELECT device_id, seq, temporal_delta_mean, temporal_delta_variance FROM feats", DELTA)
add("moving_moments", BASE, "SELECT device_id, seq, skewness, kurtosis FROM feats", "skewness kurtosis")
add("features_long", [*BASE, LONG],
    "SELECT device_id, seq, phase, feature_idx::INTEGER AS feature_idx, feature, value FROM flong", "value")

# --- scalar series -----------------------------------------------------------------------


def frame(n: int, col: str = "x") -> str:
    return f"list({col}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


add("hampel", [SERIES], f"""
  SELECT device_id, seq, CASE WHEN len(f) >= 3 AND abs(x - med) > 2.0 * (1.4826 * list_median(list_transform(f, lambda v: abs(v - med))))
      THEN med ELSE x END AS filtered
  FROM (SELECT *, list_median(f) AS med FROM (SELECT *, {frame(5)} AS f FROM series))""", "filtered")
add("savgol", [SERIES], f"""
  SELECT device_id, seq, CASE WHEN len(f) = 5 THEN list_dot_product(f, {dbl(SG)}) ELSE list_avg(f) END AS smoothed
  FROM (SELECT *, {frame(5)} AS f FROM series)""", "smoothed")
add("moving_variance", [SERIES], f"""
  SELECT device_id, seq, CASE WHEN len(f) = 20 THEN list_var_pop(f) ELSE 0.0 END AS mv
  FROM (SELECT *, {frame(20)} AS f FROM series)""", "mv")
add("rolling_stats", [SERIES], f"""
  SELECT device_id, seq, list_min(f) AS x_min, list_max(f) AS x_max, list_avg(f) AS x_mean,
    list_stddev_pop(f) AS x_stddev, len(f) AS x_count
  FROM (SELECT *, {frame(100)} AS f FROM series)""", "x_min x_max x_mean x_stddev")


def pct(p: int) -> str:
    return f"s[floor({p / 100.0} * (len(s) - 1))::INTEGER + 1]"


add("rolling_percentiles", [SERIES], f"""
  SELECT device_id, seq, {pct(25)} AS p25, {pct(50)} AS p50, {pct(75)} AS p75, {pct(95)} AS p95,
    CASE WHEN len(s) >= 50 THEN ({pct(50)} + {pct(75)}) / 2 ELSE 0.0 END AS recommended_threshold
  FROM (SELECT *, list_sort({frame(100, 'score')}) AS s FROM series)""", "p25 p50 p75 p95 recommended_threshold")


def lowpass(src: str, row: str, order: str, out: str) -> list[str]:
    """Row-by-row order-4 recurrence; ``row`` names the value and identity fields carried."""
    b, a = B_LP, A_LP
    y = " + ".join([f"{b[0]} * r.x"] + [f"{b[i]} * acc.x{i}" for i in range(1, 5)])
    y += "".join(f" - ({a[i]}) * acc.y{i}" for i in range(1, 5))
    init = ", ".join(f"'x{i}': 0.0::DOUBLE, 'y{i}': 0.0::DOUBLE" for i in range(1, 5))
    return [f"""{out}_l AS (SELECT device_id, list({row} ORDER BY {order}) AS rows FROM {src} GROUP BY device_id)""",
            f"""{out}_f AS (SELECT device_id, rows, list_reduce(rows, lambda acc, r: list_transform([({y})::DOUBLE], lambda y: {{
                'x1': r.x, 'y1': y, 'x2': acc.x1, 'y2': acc.y1, 'x3': acc.x2, 'y3': acc.y2, 'x4': acc.x3, 'y4': acc.y3,
                'o': list_append(acc.o, y)}})[1], {{{init}, 'o': []::DOUBLE[]}}).o AS o FROM {out}_l)""",
            f"""{out} AS (SELECT device_id, unnest(rows) AS r, unnest(o) AS y FROM {out}_f)"""]


add("lowpass", [SERIES, *lowpass("series", "{'x': x, 'seq': seq}", "ts, seq", "lp")],
    "SELECT device_id, r.seq AS seq, y AS lowpass FROM lp", "lowpass")
add("lowpass_big", lowpass(
    "lineitem_s", "{'x': x, 'seq': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_quantity': l_quantity}",
    "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, x", "lp"),
    "SELECT device_id, r.seq AS seq, r.l_linenumber AS l_linenumber, r.l_partkey AS l_partkey, "
    "r.l_quantity AS l_quantity, round(y, 3) AS lowpass FROM lp", "l_quantity lowpass")
ORACLES["lowpass_big"] = ORACLES["lowpass_big"].replace(
    "WITH ", "WITH lineitem_s AS (SELECT *, l_suppkey AS device_id, l_extendedprice AS x FROM lineitem),\n", 1)


def ewma(src: str, key: str, x: str, out: str = "ew", alpha: float = 0.02) -> list[str]:
    """Row-by-row EWMA; ``key`` is the grouping, the first row of a group starts at mean x, variance 1."""
    return [f"{out}_l AS (SELECT {key}, list({{'x': {x}, 'seq': seq}} ORDER BY ts, seq) AS rows FROM {src} GROUP BY {key})",
            f"""{out}_f AS (SELECT {key}, list_reduce(rows, lambda acc, r: CASE WHEN NOT acc.i
                THEN {{'i': true, 'm': r.x, 'v': 1.0::DOUBLE, 'o': list_append(acc.o, {{'seq': r.seq, 'x': r.x, 'm': r.x, 'v': 1.0::DOUBLE}})}}
                ELSE list_transform([{{'m': acc.m + {alpha} * (r.x - acc.m), 'd': r.x - acc.m}}], lambda n:
                  list_transform([((1 - {alpha}) * acc.v + {alpha} * n.d * (r.x - n.m))::DOUBLE], lambda v:
                    {{'i': true, 'm': n.m, 'v': v, 'o': list_append(acc.o, {{'seq': r.seq, 'x': r.x, 'm': n.m, 'v': v}})}})[1])[1] END,
                {{'i': false, 'm': 0.0::DOUBLE, 'v': 1.0::DOUBLE, 'o': []::STRUCT(seq BIGINT, x DOUBLE, m DOUBLE, v DOUBLE)[]}}).o AS o FROM {out}_l)""",
            f"{out} AS (SELECT {key}, unnest(o) AS r FROM {out}_f)"]


add("ewma", [SERIES, *ewma("series", "device_id", "x")],
    "SELECT device_id, r.seq AS seq, r.m AS ewma_mean, r.v AS ewma_variance, sqrt(r.v) AS ewma_stddev FROM ew",
    "ewma_mean ewma_variance ewma_stddev")
add("normaliser_report", [SERIES, *ewma("series", "device_id", "x")],
    "SELECT device_id, o[len(o)].m AS current_mean, o[len(o)].v AS current_variance, sqrt(o[len(o)].v) AS current_stddev FROM ew_f",
    "current_mean current_variance current_stddev")

LP = lowpass("series", "{'x': x, 'seq': seq, 'ts': ts}", "ts, seq", "lp")
CASCADE = [
    SERIES, *LP, "c0 AS (SELECT device_id, r.seq AS seq, r.ts AS ts, y FROM lp)",
    f"c1 AS (SELECT *, {frame(5, 'y')} AS f FROM c0)",
    "c2 AS (SELECT *, list_median(f) AS med FROM c1)",
    """c3 AS (SELECT *, CASE WHEN len(f) >= 3 AND abs(y - med) > 2.0 * (1.4826 * list_median(list_transform(f, lambda v: abs(v - med))))
        THEN med ELSE y END AS h FROM c2)""",
    f"""c4 AS (SELECT device_id, ts, seq, CASE WHEN len(f) = 5
        THEN list_dot_product(f[1:4], {dbl(SG[:4])}) + ({SG[4]}) * h ELSE h END AS filtered FROM c3)""",
    *ewma("c4", "device_id", "filtered"),
]
add("filter_cascade", CASCADE,
    "SELECT device_id, r.seq AS seq, r.x AS filtered, r.m AS ewma_mean, r.v AS ewma_variance FROM ew",
    "filtered ewma_mean ewma_variance")


def analysis(src: str, n: int, taps) -> str:
    return (f"list_transform(range(0, {n // 2}), lambda i: list_sum(list_transform(range(0, 8), "
            f"lambda j: {src}[(2*i + j) % {n} + 1] * ({dbl(taps)})[j + 1])))")


def synthesis(a: str, d: str, n: int, lo, hi) -> str:
    """Sample k collects coefficient i through tap j wherever (2i + j) mod n = k."""
    return (f"list_transform(range(0, {n}), lambda k: list_sum(list_transform(range(0, {n // 2}), lambda i: "
            f"list_sum(list_transform(range(0, 8), lambda j: CASE WHEN (2*i + j) % {n} = k THEN "
            f"{a}[i + 1] * ({dbl(lo)})[j + 1] + {d}[i + 1] * ({dbl(hi)})[j + 1] ELSE 0.0 END)))))")


def soft(d: str, t: float) -> str:
    return f"list_transform({d}, lambda v: sign(v) * greatest(abs(v) - {t}, 0.0))"


def hard(d: str, t: float) -> str:
    return f"list_transform({d}, lambda v: CASE WHEN abs(v) > {t} THEN v ELSE 0.0 END)"


def denoise2(src: str, t: float) -> list[str]:
    """Two-level soft denoising of the 32-sample list ``s`` with the analysis taps on both sides."""
    return [f"w1 AS (SELECT *, {analysis('s', 32, DB4_LOW)} AS a1, {soft(analysis('s', 32, DB4_HIGH), t)} AS d1 FROM {src})",
            f"w2 AS (SELECT *, {analysis('a1', 16, DB4_LOW)} AS a2, {soft(analysis('a1', 16, DB4_HIGH), t)} AS d2 FROM w1)",
            f"w3 AS (SELECT *, {synthesis('a2', 'd2', 16, DB4_LOW, DB4_HIGH)} AS r1 FROM w2)",
            f"w4 AS (SELECT *, {synthesis('r1', 'd1', 32, DB4_LOW, DB4_HIGH)} AS y FROM w3)"]


BLOCKS = """blk AS (SELECT device_id, p // 32 AS block, list(x ORDER BY p) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) - 1 AS p FROM series) GROUP BY ALL HAVING count(*) = 32)"""
add("wavelet_sliding", [SERIES, f"""fr AS (SELECT device_id, seq, x, {frame(32)} AS s,
      row_number() OVER ({W}) AS rn FROM series)""", "fu AS (SELECT * FROM fr WHERE rn > 32)", *denoise2("fu", 20.0)],
    "SELECT device_id, seq, y[17] AS denoised FROM w4 UNION ALL SELECT device_id, seq, x FROM fr WHERE rn <= 32", "denoised")
add("wavelet_block", [SERIES, BLOCKS, *denoise2("blk", 20.0)],
    "SELECT device_id, block, (unnest(range(0, 32)))::INTEGER AS i, unnest(y) AS value FROM w4", "value")
add("wavelet_block_as_coded", [
    SERIES, BLOCKS,
    f"w1 AS (SELECT *, {analysis('s', 32, DB4_LOW)} AS a1, {hard(analysis('s', 32, DB4_HIGH), 20.0)} AS d1 FROM blk)",
    f"w2 AS (SELECT *, {synthesis('a1', 'd1', 32, DB4_SYN_LOW, DB4_SYN_HIGH)} AS y FROM w1)"],
    "SELECT device_id, block, (unnest(range(0, 32)))::INTEGER AS i, unnest(y) AS value FROM w2", "value")
add("shrinkage", [SERIES], """
  SELECT device_id, seq, CASE WHEN v > 25 THEN v - 25 WHEN v < -25 THEN v + 25 ELSE 0.0 END AS soft,
    CASE WHEN v > 25 OR v < -25 THEN v ELSE 0.0 END AS hard, isfinite(v) AS is_finite
  FROM (SELECT *, x - 60.0 AS v FROM series)""", "soft hard")
add("noise_sigma", [SERIES], """
  SELECT device_id, (date_part('epoch', date_trunc('day', ts)) / 86400)::INTEGER AS day,
    median(abs(x - 50.0)) / 0.6745 AS sigma FROM series GROUP BY ALL""", "sigma")

# --- detection and publishing ------------------------------------------------------------


def states(src: str, debounce: int, persistence: int, out: str = "st") -> list[str]:
    """Row-by-row debounce machine over device_id, ts, seq, score, threshold."""
    t = "STRUCT(seq BIGINT, d BOOLEAN, f BOOLEAN)[]"

    def nxt(m: int, c: str, t0: str, fell: str = "false") -> str:
        return (f"{{'m': {m}, 'c': {c}, 't': {t0}, 'o': list_append(acc.o, "
                f"{{'seq': r.seq, 'd': {'true' if m else 'false'}, 'f': {fell}}})}}")

    return [
        f"""{out}_l AS (SELECT device_id, list({{'seq': seq, 'a': score > threshold,
              't': floor(epoch_us(ts) / 1000000)::BIGINT}} ORDER BY ts, seq) AS rows FROM {src} GROUP BY device_id)""",
        f"""{out}_f AS (SELECT device_id, unnest(list_reduce(rows, lambda acc, r: CASE
              WHEN acc.m = 0 AND r.a AND acc.c + 1 >= {debounce} THEN {nxt(1, '0', 'r.t')}
              WHEN acc.m = 0 AND r.a THEN {nxt(0, 'acc.c + 1', 'acc.t')}
              WHEN acc.m = 0 THEN {nxt(0, '0', 'acc.t')}
              WHEN r.a OR r.t - acc.t <= {persistence} THEN {nxt(1, '0', 'acc.t')}
              ELSE {nxt(0, '0', 'acc.t', 'true')} END,
              {{'m': 0, 'c': 0, 't': 0::BIGINT, 'o': []::{t}}}).o) AS r FROM {out}_l)""",
        f"""{out} AS MATERIALIZED (SELECT s.device_id, s.ts, s.seq, s.score, s.threshold,
              CASE WHEN f.r.d THEN 'DETECTED' ELSE 'IDLE' END AS state,
              CASE WHEN f.r.f THEN 0.0 WHEN s.threshold > 1e-6 THEN least(1.0, s.score / (s.threshold + 1e-6))
                   WHEN s.score > 0 THEN 1.0 ELSE 0.0 END AS confidence
            FROM {src} s JOIN {out}_f f ON f.device_id = s.device_id AND f.r.seq = s.seq)"""]


SERIES_ST = [SERIES, "sth AS (SELECT *, 0.53::DOUBLE AS threshold FROM series)", *states("sth", 2, 6 * H)]

add("default_score", [*BASE, SCORED], "SELECT device_id, seq, score FROM scored", "score")
DETECTIONS = [*BASE, SCORED, "pth AS (SELECT *, 0.53::DOUBLE AS threshold FROM scored)", *states("pth", 2, 1)]
add("motion_detections", DETECTIONS,
    "SELECT device_id, seq, epoch_us(ts) AS ts, score, state, confidence FROM st", "score confidence")
add("series_detections", SERIES_ST, "SELECT device_id, seq, state, confidence FROM st", "confidence")
add("detection_events", SERIES_ST,
    "SELECT device_id, score AS movement, confidence, state, floor(epoch_us(ts) / 1000000)::BIGINT AS timestamp FROM st",
    "movement confidence")

# Ticks straight from their meaning: a calendar per device, joined as of.
def ticks(hi: str) -> list[str]:
    return [f"""cal AS (SELECT device_id, unnest(range(lo, hi + 1)) AS k FROM (
          SELECT device_id, ceil(min(epoch_us(ts)) / {H * 1e6})::BIGINT AS lo, ({hi})::BIGINT AS hi FROM st GROUP BY device_id))""", TICK]


TICK = f"""tick AS MATERIALIZED (SELECT c.device_id, c.k * {H * 1000000} AS us, s.state, s.score, s.confidence
          FROM cal c ASOF JOIN (SELECT *, epoch_us(ts) AS us FROM st) s ON c.device_id = s.device_id AND c.k * {H * 1000000} >= s.us)"""
TICKS = ticks(f"ceil(max(epoch_us(ts)) / {H * 1e6})")
# A stream goes on for silent devices, to the first tick after the table.
LIVE_TICKS = ticks(f"SELECT floor(max(epoch_us(ts)) / {H * 1e6}) + 1 FROM st")
add("tick_samples", [*SERIES_ST, *TICKS], "SELECT device_id, us AS ts, state, score, confidence FROM tick", "score confidence")
GATE_ROW = "STRUCT(us BIGINT, p BOOLEAN)[]"
GATE = [
    "g_l AS (SELECT device_id, list({'us': us, 's': state, 'v': score} ORDER BY us) AS rows FROM tick GROUP BY device_id)",
    f"""g_f AS (SELECT device_id, unnest(list_reduce(rows, lambda acc, r: CASE
          WHEN acc.t IS NULL OR r.s <> acc.s OR abs(r.v - acc.v) > 0.05 OR r.us // 1000 - acc.t // 1000 >= {12 * H * 1000}
          THEN {{'t': r.us, 's': r.s, 'v': r.v, 'o': list_append(acc.o, {{'us': r.us, 'p': true}})}}
          ELSE {{'t': acc.t, 's': acc.s, 'v': acc.v, 'o': list_append(acc.o, {{'us': r.us, 'p': false}})}} END,
          {{'t': NULL::BIGINT, 's': ''::VARCHAR, 'v': 0.0::DOUBLE, 'o': []::{GATE_ROW}}}).o) AS r FROM g_l)""",
    """gate AS MATERIALIZED (SELECT t.device_id, t.us AS ts, t.state, t.score, g.r.p AS published
          FROM tick t JOIN g_f g ON g.device_id = t.device_id AND g.r.us = t.us)"""]
add("publish_gate", [*SERIES_ST, *TICKS, *GATE], "SELECT * FROM gate", "score")
add("emission_reduction", [*SERIES_ST, *TICKS, *GATE], """
  SELECT device_id, count(*) FILTER (published) AS published, count(*) FILTER (NOT published) AS skipped,
    count(*) FILTER (NOT published) * 100.0 / count(*) AS reduction_pct FROM gate GROUP BY device_id""", "reduction_pct")
add("packet_rate", [PACKETS, MIXED], """
  SELECT device_id, floor(epoch_us(ts) / 1000000)::BIGINT AS second, count(*) AS received,
    count(*) FILTER (len(iq) >= 10) AS processed, count(*) FILTER (len(iq) < 10) AS dropped,
    count(*) FILTER (len(iq) >= 10) * 100.0 / count(*) AS success_pct FROM mixed GROUP BY ALL""", "success_pct")
add("movement_alerts", SERIES_ST, f"""
  SELECT device_id, seq, score, confidence FROM (
    SELECT *, coalesce(lag(hot) OVER ({W}), false) AS was FROM (SELECT *, score > 0.6 AND confidence > 0.7 AS hot FROM st))
  WHERE hot AND NOT was""", "score confidence")
add("inactivity_alerts", SERIES_ST, f"""
  SELECT device_id, epoch_us(lo) AS idle_since, epoch_us(lo + INTERVAL 4 HOUR) AS alert_ts,
    (epoch_us(until) - epoch_us(lo)) / 3.6e9 AS idle_hours
  FROM (SELECT device_id, min(ts) AS lo, max(nxt) AS until, any_value(state) AS state FROM (
      SELECT *, count(*) FILTER (chg) OVER ({W}) AS run FROM (
        SELECT *, coalesce(lead(ts) OVER ({W}), ts) AS nxt, state IS DISTINCT FROM lag(state) OVER ({W}) AS chg FROM st))
    GROUP BY device_id, run)
  WHERE state = 'IDLE' AND until >= lo + INTERVAL 4 HOUR AND hour(lo + INTERVAL 4 HOUR) BETWEEN 8 AND 21""", "idle_hours")
add("occupancy", SERIES_ST, """
  SELECT device_id % 12 AS zone, (epoch_us(ts) // 21600000000) * 21600000000 AS window_start, bool_or(state = 'DETECTED') AS occupied,
    max(score) AS peak, count(DISTINCT device_id) FILTER (state = 'DETECTED') AS devices FROM st GROUP BY ALL""", "peak")
add("state_names", [], """
  SELECT CASE l_linenumber - 1 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'DETECTED' ELSE 'UNKNOWN' END AS state,
    CASE l_linenumber - 1 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'BASELINE' WHEN 2 THEN 'MOVEMENT' WHEN 3 THEN 'ANALYZING' ELSE 'UNKNOWN' END AS phase,
    count(*) AS n FROM lineitem GROUP BY ALL""")
RESET_TICKS = [
    "rt_l AS (SELECT device_id, list({'us': us, 'm': state <> 'IDLE'} ORDER BY us) AS rows FROM tick GROUP BY device_id)",
    f"""rt_f AS (SELECT device_id, list_reduce(rows, lambda acc, r: CASE
          WHEN r.m THEN {{'t': r.us, 'o': acc.o}}
          WHEN acc.t IS NOT NULL AND r.us - acc.t >= {24 * H * 1000000} THEN {{'t': r.us, 'o': list_append(acc.o, r.us)}}
          ELSE acc END, {{'t': NULL::BIGINT, 'o': []::BIGINT[]}}).o AS o FROM rt_l)""",
    "rt AS (SELECT device_id, unnest(o) AS us, unnest(range(1, len(o) + 1)) AS n FROM rt_f)"]
RESET = [*RESET_TICKS, """rs AS (SELECT s.device_id, s.ts, s.seq, s.x, coalesce(r.n, 0) AS epoch
          FROM (SELECT *, epoch_us(ts) AS us FROM series) s ASOF LEFT JOIN rt r ON s.device_id = r.device_id AND s.us > r.us)"""]
add("ewma_reset", [*SERIES_ST, *TICKS, *RESET, *ewma("rs", "device_id, epoch", "x")],
    "SELECT device_id, r.seq AS seq, epoch, r.m AS ewma_mean, r.v AS ewma_variance FROM ew", "ewma_mean ewma_variance")

# --- calibration -------------------------------------------------------------------------

STATS = """stats AS (SELECT device_id, phase, feature_idx, feature, count(*) AS n, avg(value) AS mean,
    coalesce(var_samp(value), 0.0) AS var, min(value) AS min, max(value) AS max FROM flong GROUP BY ALL)"""
PAIRS = """pairs AS MATERIALIZED (SELECT b.device_id, b.feature_idx, b.feature, b.n AS b_n, m.n AS m_n, b.mean AS b_mean, m.mean AS m_mean,
    b.var AS b_var, m.var AS m_var, least(b.min, m.min) AS lo, greatest(b.max, m.max) AS hi
    FROM stats b JOIN stats m USING (device_id, feature_idx) WHERE b.phase = 'BASELINE' AND m.phase = 'MOVEMENT')"""
FISHER = """fish AS MATERIALIZED (SELECT *, CASE WHEN bad THEN 0.0 ELSE d2 / sqrt(v) END AS fisher,
    CASE WHEN bad THEN 0.0 ELSE d2 / v END AS standard_fisher
    FROM (SELECT *, pow((m_mean - b_mean) / (hi - lo), 2) AS d2, (b_var + m_var) / pow(hi - lo, 2) AS v,
        b_n < 2 OR m_n < 2 OR hi - lo < 1e-6 OR (b_var + m_var) / pow(hi - lo, 2) < 1e-6 AS bad FROM pairs))"""
RANKED = """ranked AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY fisher DESC, feature_idx))::INTEGER AS rank,
    max(fisher) OVER (PARTITION BY device_id) AS best FROM fish)"""
MODEL = """model AS MATERIALIZED (SELECT *, fisher / sum(fisher) OVER (PARTITION BY device_id) AS weight,
    CASE WHEN hi - lo > 1e-6 THEN lo - (hi - lo) * 0.1 ELSE (lo + hi) / 2 - 0.05 END AS feat_min,
    CASE WHEN hi - lo > 1e-6 THEN hi + (hi - lo) * 0.1 ELSE (lo + hi) / 2 + 0.05 END AS feat_max
    FROM ranked WHERE b_n >= 50 AND m_n >= 50 AND best > 0 AND (rank <= 4 OR (rank <= 6 AND fisher >= 0.2 * best)))"""
SUMMARY = f"""summ AS MATERIALIZED (
  SELECT *, least(greatest(least(greatest(raw * margin, b + (m - b) * 0.3), b + (m - b) * 0.7), 0.15), 0.80)::DOUBLE AS threshold
  FROM (SELECT *, CASE WHEN sb + sm >= 1e-6 THEN (sm * b + sb * m) / (sb + sm) ELSE (b + m) / 2 END AS raw,
      CASE WHEN ratio < 2 THEN greatest(1.0, least(1 + (ratio - 1) * 0.5, 1.05)) ELSE 1.05 END AS margin
    FROM (SELECT *, CASE WHEN b > 1e-6 THEN m / b ELSE 0.0 END AS ratio
      FROM (SELECT device_id, max(b_n) AS baseline_samples, max(m_n) AS movement_samples, count(*) AS num_selected,
          sum(weight * {norm('b_mean', 'feat_min', 'feat_max')}) AS b, sum(weight * {norm('m_mean', 'feat_min', 'feat_max')}) AS m,
          sum(b_var * weight * weight) AS sb, sum(m_var * weight * weight) AS sm FROM model GROUP BY device_id))))"""
CAL = [*BASE, LONG, STATS, PAIRS, FISHER, RANKED, MODEL, SUMMARY]

NUMBERED = "nump AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS rn FROM packets)"
PHASED = """phased AS (SELECT device_id, ts, seq, CASE WHEN rn <= 60 THEN 'BASELINE' WHEN rn <= 120 THEN 'MOVEMENT' END AS phase,
    CASE WHEN rn <= 60 THEN rn WHEN rn <= 120 THEN rn - 60 END AS sample_in_phase FROM nump)"""
add("phase_assignment", [PACKETS, NUMBERED, PHASED], "SELECT device_id, seq, coalesce(phase, '') AS phase, coalesce(sample_in_phase, 0) AS sample_in_phase FROM phased")
# Sessions: packets and commands of a device gone through one by one.
CALLS = """calls AS (SELECT * FROM (SELECT device_id, ts, seq, CASE WHEN q IN (1, 3, 15, 16) THEN 'start' WHEN q IN (5, 12, 20) THEN 'status' WHEN q = 14 THEN 'stop' WHEN q = 22 THEN 'pause' END AS action,
      CASE q WHEN 1 THEN 50 WHEN 3 THEN 60 WHEN 15 THEN 20 WHEN 16 THEN 55 END AS samples, q = 16 AS raw
    FROM (SELECT *, (seq // 10) % 25 AS q FROM packets WHERE seq % 10 IN (0, 5, 8))) WHERE action IS NOT NULL)"""


def session_fold(extra: str = "") -> list[str]:
    return [f"""line AS (SELECT device_id, ts, 0 AS kind, seq, action, samples, raw FROM calls WHERE action <> 'pause'
        UNION ALL SELECT device_id, ts, 1, seq, NULL, NULL, NULL FROM packets{extra})""",
        """ses_l AS (SELECT device_id, list({'seq': seq, 'kind': kind, 'a': action, 'n': samples, 'v': raw} ORDER BY ts, kind, seq) AS rows FROM line GROUP BY device_id)""",
        """ses AS MATERIALIZED (SELECT device_id, unnest(list_reduce(rows, lambda acc, r: CASE
          WHEN r.kind = 1 AND acc.ph > 0 THEN {'s': acc.s, 'ph': CASE WHEN acc.c + 1 < acc.n THEN acc.ph WHEN acc.ph = 1 THEN 2 ELSE 0 END, 'c': CASE WHEN acc.c + 1 < acc.n THEN acc.c + 1 ELSE 0 END, 'n': acc.n,
            'o': list_append(acc.o, {'seq': r.seq, 'kind': 1, 'a': '', 's': acc.s, 'ph': acc.ph, 'c': acc.c + 1, 'n': acc.n, 'ok': true, 'v': false})}
          WHEN r.kind = 1 THEN acc
          WHEN r.a = 'start' AND acc.ph = 0 AND r.n BETWEEN 50 AND 10000 THEN {'s': acc.s + 1, 'ph': 1, 'c': 0::BIGINT, 'n': r.n,
            'o': list_append(acc.o, {'seq': r.seq, 'kind': 0, 'a': r.a, 's': acc.s + 1, 'ph': 1, 'c': 0::BIGINT, 'n': r.n, 'ok': true, 'v': r.v})}
          WHEN r.a = 'stop' THEN {'s': acc.s, 'ph': 0, 'c': 0::BIGINT, 'n': acc.n,
            'o': list_append(acc.o, {'seq': r.seq, 'kind': 0, 'a': r.a, 's': acc.s, 'ph': 0, 'c': 0::BIGINT, 'n': acc.n, 'ok': true, 'v': false})}
          ELSE {'s': acc.s, 'ph': acc.ph, 'c': acc.c, 'n': acc.n,
            'o': list_append(acc.o, {'seq': r.seq, 'kind': 0, 'a': r.a, 's': acc.s, 'ph': acc.ph, 'c': acc.c, 'n': acc.n, 'ok': r.a = 'status', 'v': false})} END,
          {'s': 0::BIGINT, 'ph': 0, 'c': 0::BIGINT, 'n': 0, 'o': []::STRUCT(seq BIGINT, kind INTEGER, a VARCHAR, s BIGINT, ph INTEGER, c BIGINT, n INTEGER, ok BOOLEAN, v BOOLEAN)[]}).o) AS r FROM ses_l)"""]


PHASE_NAME = "CASE r.ph WHEN 1 THEN 'BASELINE' WHEN 2 THEN 'MOVEMENT' ELSE 'IDLE' END"
add("calibration_sessions", [PACKETS, CALLS, *session_fold()], f"""
  SELECT device_id, r.seq AS seq, r.s AS session, {PHASE_NAME} AS phase, r.c AS sample_in_phase FROM ses WHERE r.kind = 1""")
add("calibration_calls", [PACKETS, CALLS, *session_fold()], f"""
  SELECT device_id, r.seq AS seq, r.a AS action, r.s AS session, r.ok AS taken, {PHASE_NAME} AS phase, CASE
      WHEN r.a = 'start' AND r.ok THEN 'Calibration started (' || r.n || ' samples per phase' || CASE WHEN r.v THEN ', CSI raw logging enabled)' ELSE ')' END
      WHEN r.a = 'start' THEN 'ERROR: Failed to start calibration (already in progress?)' WHEN r.a = 'stop' THEN 'Calibration stopped'
      WHEN r.ph = 0 THEN '{{"phase":"IDLE","active":false}}'
      ELSE '{{"phase":"' || {PHASE_NAME} || '","active":true,"samples_collected":' || r.c || ',"samples_target":' || r.n || ',"estimated_time_remaining_sec":' || (r.n - r.c) // 20 || '}}' END AS response
  FROM ses WHERE r.kind = 0
  UNION ALL SELECT device_id, seq, action, 0, false, '', 'ERROR: Unknown calibration action ''pause'' (use: start, stop, status)' FROM calls WHERE action = 'pause'""")
add("calibrate_status", [PACKETS, CALLS, *session_fold(" UNION ALL SELECT device_id, max(ts) + INTERVAL 1 SECOND, 0, -1, 'status', NULL, NULL FROM packets GROUP BY device_id")], f"""
  SELECT device_id, r.s AS session, {PHASE_NAME} AS phase, r.ph > 0 AS active, CASE WHEN r.ph > 0 THEN r.c END AS samples_collected, CASE WHEN r.ph > 0 THEN r.n::BIGINT END AS samples_target,
    CASE WHEN r.ph > 0 THEN ((r.n - r.c) // 20)::BIGINT END AS estimated_time_remaining_sec FROM ses WHERE r.seq = -1""")
add("calibration_progress", [PACKETS], """
  SELECT device_id, phase, samples_collected,
    CASE phase WHEN 'ANALYZING' THEN 1.0 WHEN 'MOVEMENT' THEN 0.5 + 0.5 * samples_collected / 80.0 ELSE 0.5 * samples_collected / 80.0 END AS progress,
    80 - samples_collected AS samples_remaining,
    CASE WHEN samples_collected < 80 THEN (80 - samples_collected) // 20 ELSE 0 END AS eta_seconds
  FROM (SELECT device_id, CASE WHEN n >= 160 THEN 'ANALYZING' WHEN n >= 80 THEN 'MOVEMENT' ELSE 'BASELINE' END AS phase,
      CASE WHEN n >= 160 THEN 80 WHEN n >= 80 THEN n - 80 ELSE n END AS samples_collected
    FROM (SELECT device_id, count(*) AS n FROM packets GROUP BY device_id))""", "progress")
add("phase_events", [PACKETS, NUMBERED, PHASED], f"""
  SELECT device_id, seq, 'calibration_status' AS type, ph AS phase, (CASE WHEN ph = 'ANALYZING' THEN 0 ELSE 60 END)::INTEGER AS phase_target_samples
  FROM (SELECT *, lag(ph) OVER ({W}) AS pp FROM (SELECT *, coalesce(phase, 'ANALYZING') AS ph FROM phased))
  WHERE ph IS DISTINCT FROM pp""")
add("feature_stats", [*BASE, LONG, STATS], "SELECT * REPLACE (feature_idx::INTEGER AS feature_idx) FROM stats", "mean var min max")
add("fisher_rank", CAL, "SELECT device_id, feature_idx::INTEGER AS feature_idx, feature, fisher, standard_fisher, rank FROM ranked",
    "fisher standard_fisher")
add("separation_approaches", [
    *CAL,
    """sep AS (SELECT *, CASE WHEN b_var + m_var > 1e-6 THEN pow(m_mean - b_mean, 2) / (b_var + m_var) ELSE 0.0 END AS f,
        CASE WHEN b_var + m_var > 1e-6 THEN pow(m_mean - b_mean, 2) / sqrt(b_var + m_var) ELSE 0.0 END AS g,
        greatest(abs(b_mean) + 1e-6, abs(m_mean) + 1e-6) / least(abs(b_mean) + 1e-6, abs(m_mean) + 1e-6) AS r,
        m_mean / (b_mean + 1e-6) AS s FROM pairs)""",
    """pick AS (SELECT device_id,
        first(feature ORDER BY f DESC, feature_idx) AS fisher_feature, first(s ORDER BY f DESC, feature_idx) AS fisher_separation,
        first(feature ORDER BY g DESC, feature_idx) AS modified_feature, first(s ORDER BY g DESC, feature_idx) AS modified_separation,
        first(feature ORDER BY r DESC, feature_idx) AS ratio_feature, first(r ORDER BY r DESC, feature_idx) AS ratio_separation
      FROM sep GROUP BY device_id)"""],
    """SELECT *, CASE WHEN fisher_separation >= greatest(modified_separation, ratio_separation) THEN 'fisher'
        WHEN modified_separation >= ratio_separation THEN 'modified_fisher' ELSE 'mean_ratio' END AS winner FROM pick""",
    "fisher_separation modified_separation ratio_separation")
add("calibration_model", CAL, "SELECT device_id, rank, feature_idx::INTEGER AS feature_idx, feature, fisher, weight, feat_min, feat_max FROM model",
    "fisher weight feat_min feat_max")
QUALITY = "CASE WHEN ratio >= 2.5 THEN 'excellent' WHEN ratio >= 2 THEN 'good' WHEN ratio >= 1.5 THEN 'fair' ELSE 'poor' END"
add("calibration_summary", CAL, f"""
  SELECT device_id, baseline_samples, movement_samples, b AS baseline_score, m AS movement_score, ratio AS separation_ratio,
    {QUALITY} AS quality, num_selected, threshold, m < b AS inverted,
    CASE WHEN ratio < 2 THEN printf('Low separation ratio (%.2f < 2.0) - consider more intense movement', ratio) ELSE '' END AS warning
  FROM summ""", "baseline_score movement_score separation_ratio threshold")
add("calibration_status", CAL, """
  SELECT p.device_id, min(b_n) AS baseline_samples, min(m_n) AS movement_samples,
    CASE WHEN any_value(s.device_id) IS NOT NULL THEN 'DONE' ELSE 'FAILED' END AS status,
    CASE WHEN any_value(s.device_id) IS NOT NULL THEN '' WHEN min(b_n) < 50 OR min(m_n) < 50 THEN 'insufficient samples'
         ELSE 'no separation' END AS reason
  FROM pairs p LEFT JOIN summ s USING (device_id) GROUP BY p.device_id""")
# One device without movement: its calibration fails.
PARTIAL = PACKETS.replace("FROM embeddings)", "FROM embeddings WHERE NOT (vec_id % 10 >= 8 AND label >= 5))")
add("calibration_status_partial", [PARTIAL, *CAL[1:], """cnt AS (SELECT device_id, coalesce(min(n) FILTER (phase = 'BASELINE'), 0) AS b,
    coalesce(min(n) FILTER (phase = 'MOVEMENT'), 0) AS m FROM stats GROUP BY device_id)"""], """
  SELECT c.device_id, c.b AS baseline_samples, c.m AS movement_samples,
    CASE WHEN s.device_id IS NOT NULL THEN 'DONE' ELSE 'FAILED' END AS status,
    CASE WHEN s.device_id IS NOT NULL THEN '' WHEN c.b < 50 OR c.m < 50 THEN 'insufficient samples' ELSE 'no separation' END AS reason
  FROM cnt c LEFT JOIN summ s ON s.device_id = c.device_id""")
ADVICE = """qual AS MATERIALIZED (SELECT device_id, count(*) FILTER (b_n >= 2 AND b_mean > 0.01 AND b_var > 4 * b_mean * b_mean) / 10.0::DOUBLE AS outlier_ratio,
    coalesce(avg(abs(m_mean - b_mean) / sqrt(b_var)) FILTER (b_n >= 2 AND m_n >= 2 AND sqrt(b_var) > 1e-6), 0.0) AS snr,
    coalesce(avg(sqrt(b_var) / b_mean) FILTER (b_n >= 2 AND b_mean > 1e-6), 0.0) AS drift,
    max(b_mean) FILTER (feature_idx = 0) AS baseline_variance FROM pairs GROUP BY device_id)"""
add("filter_recommendation", [*CAL, ADVICE], """
  SELECT *, true AS butterworth, outlier_ratio > 0.05 AS hampel,
    CASE WHEN outlier_ratio > 0.15 THEN 3.0 WHEN outlier_ratio > 0.05 THEN 2.0 END AS hampel_threshold, snr < 10 AS savgol,
    baseline_variance > 500 AS wavelet, 3 AS wavelet_level,
    CASE WHEN baseline_variance > 800 THEN 2.0 WHEN baseline_variance > 600 THEN 1.5 ELSE 1.0 END AS wavelet_threshold,
    drift > 0.1 AS adaptive_normalizer, CASE WHEN drift > 0.3 THEN 0.02 WHEN drift > 0.1 THEN 0.01 END AS adaptive_normalizer_alpha
  FROM qual""", "outlier_ratio snr drift baseline_variance hampel_threshold wavelet_threshold adaptive_normalizer_alpha")
add("model_validity", CAL, """
  SELECT m.device_id, count(*) AS n, sum(weight) AS weight_sum, any_value(s.threshold) AS threshold,
    count(*) BETWEEN 1 AND 6 AND count(DISTINCT feature_idx) = count(*) AND bool_and(feature_idx BETWEEN 0 AND 9 AND weight BETWEEN 0 AND 1)
      AND sum(weight) BETWEEN 0.8 AND 1.2 AND any_value(s.threshold) > 0 AND any_value(s.threshold) < 1 AS valid_stored,
    count(*) BETWEEN 1 AND 6 AND count(DISTINCT feature_idx) = count(*) AND bool_and(feature_idx BETWEEN 0 AND 9 AND weight BETWEEN 0 AND 1)
      AND sum(weight) BETWEEN 0.8 AND 1.2 AND any_value(s.threshold) BETWEEN 0.05 AND 0.95 AS valid_applied
  FROM model m JOIN summ s USING (device_id) GROUP BY m.device_id""", "weight_sum threshold")
add("calibration_report", [*CAL, ADVICE], f"""
  SELECT s.device_id, 'calibration_complete' AS type, baseline_samples, {QUALITY} AS quality, threshold, num_selected,
    (SELECT feature FROM model m WHERE m.device_id = s.device_id AND rank = 1) AS top_1,
    (SELECT feature FROM model m WHERE m.device_id = s.device_id AND rank = 3) AS top_3, 3 AS n_top, q.snr < 10 AS savgol,
    CASE WHEN q.baseline_variance > 500 THEN 3 ELSE 0 END AS wavelet_level, CASE WHEN ratio < 2 THEN 1 ELSE 0 END AS n_warnings
  FROM summ s JOIN qual q USING (device_id)""", "threshold")
WMAP = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
add("feature_report", CAL, f"""
  SELECT device_id, feature_idx, feature, value, weight IS NOT NULL AS selected, weight
  FROM (SELECT f.device_id, f.feature_idx::INTEGER AS feature_idx, f.feature, f.value,
      CASE WHEN m.weight IS NOT NULL THEN m.weight
           WHEN f.device_id NOT IN (SELECT device_id FROM summ) AND (CASE f.feature_idx {WMAP} END) > 0
           THEN (CASE f.feature_idx {WMAP} END)::DOUBLE END AS weight
    FROM (SELECT * FROM flong QUALIFY row_number() OVER (PARTITION BY device_id, feature_idx ORDER BY ts DESC, seq DESC) = 1) f
    LEFT JOIN model m USING (device_id, feature_idx))""", "value weight")
add("model_store", CAL, """
  SELECT m.device_id, rank, feature_idx::INTEGER AS feature_idx, weight, feat_min, feat_max, s.threshold
  FROM model m JOIN summ s USING (device_id)""", "weight feat_min feat_max threshold")
CSCORE = [*CAL, LONG, f"""csum AS (SELECT l.device_id, l.seq, sum(m.weight * {norm('l.value', 'm.feat_min', 'm.feat_max')}) AS cscore
    FROM flong l JOIN model m USING (device_id, feature_idx) GROUP BY ALL)""",
    SCORED, """cs AS MATERIALIZED (SELECT s.device_id, s.ts, s.seq, coalesce(c.cscore, s.score) AS score,
      CASE WHEN c.cscore IS NULL THEN 'default' ELSE 'calibrated' END AS mode FROM scored s LEFT JOIN csum c USING (device_id, seq))"""]
add("calibrated_score", CSCORE, "SELECT device_id, seq, score, mode FROM cs", "score")
add("calibrated_detections", [
    *CSCORE, "cth AS (SELECT c.*, coalesce(s.threshold, 0.53)::DOUBLE AS threshold FROM cs c LEFT JOIN summ s USING (device_id))",
    *states("cth", 2, 1)],
    "SELECT device_id, seq, score, threshold, state, confidence FROM st", "score threshold confidence")

# --- segmentation ------------------------------------------------------------------------

TURB = f"""turb AS MATERIALIZED (SELECT device_id, phase, seq, list_stddev_pop({amps('band')}) AS t,
    row_number() OVER (PARTITION BY device_id, phase ORDER BY ts, seq) - 1 AS p FROM (SELECT *, iq[13:116] AS band FROM packets))"""


def moving(w: int) -> str:
    return (f"SELECT device_id, phase, p, t, {w} AS w, CASE WHEN p >= {w - 1} THEN var_pop(t) OVER (PARTITION BY device_id, phase "
            f"ORDER BY p ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) ELSE 0.0 END AS mv FROM turb")


LEVELS = """lev AS MATERIALIZED (SELECT device_id, w, avg(mv) AS mean_variance, stddev_pop(mv) AS std_variance FROM mov
    WHERE phase = 'BASELINE' AND p >= w - 1 GROUP BY device_id, w)"""


def segs(src: str, keys: str, out: str = "seg") -> list[str]:
    """Row-by-row segmenter over p, mv, thr and cap."""
    def keep(st: str, ln: str, o: str = "acc.o") -> str:
        return f"{{'st': {st}, 'ln': {ln}, 'o': {o}}}"

    closed = "list_append(acc.o, {'st': acc.st, 'ln': acc.ln + 1})"
    return [f"{out}_l AS (SELECT {keys}, list({{'p': p, 'mv': mv, 'thr': thr, 'cap': cap}} ORDER BY p) AS rows FROM {src} GROUP BY {keys})",
            f"""{out} AS MATERIALIZED (SELECT {keys}, list_reduce(rows, lambda acc, r: CASE
              WHEN acc.ln = 0 AND r.mv > r.thr THEN {keep('r.p', '1::BIGINT')}
              WHEN acc.ln = 0 THEN acc
              WHEN r.mv < r.thr OR acc.ln + 1 >= r.cap THEN {keep('0::BIGINT', '0::BIGINT', closed)}
              ELSE {keep('acc.st', 'acc.ln + 1')} END,
              {{'st': 0::BIGINT, 'ln': 0::BIGINT, 'o': []::STRUCT(st BIGINT, ln BIGINT)[]}}).o AS o FROM {out}_l)"""]


MOV10 = [PACKETS, TURB, f"mov AS MATERIALIZED ({moving(10)})", LEVELS]
SEGS = [*MOV10, """sin AS (SELECT m.*, l.mean_variance + 0.5 * l.std_variance AS thr, 40 AS cap FROM mov m JOIN lev l USING (device_id, w))""",
        *segs("sin", "device_id, phase"),
        """sg AS MATERIALIZED (SELECT device_id, phase, s.st AS start_pos, s.ln AS length FROM (
            SELECT device_id, phase, unnest(o) AS s FROM seg) WHERE s.ln >= 5)"""]
add("adaptive_threshold", MOV10,
    "SELECT device_id, mean_variance, std_variance, mean_variance + 2.5 * std_variance AS threshold FROM lev",
    "mean_variance std_variance threshold")
add("motion_segments", SEGS, "SELECT * FROM sg")
SEGF = "variance std mean max min range iqr median duration start_time"
add("segment_features", SEGS, """
  SELECT g.device_id, g.phase, g.start_pos, g.length, var_pop(t) AS variance, stddev_pop(t) AS std, avg(t) AS mean, max(t) AS max, min(t) AS min,
    max(t) - min(t) AS range, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS iqr, median(t) AS median,
    g.length / 20.0 AS duration, g.start_pos / 20.0 AS start_time
  FROM sg g JOIN turb u ON u.device_id = g.device_id AND u.phase = g.phase AND u.p BETWEEN g.start_pos AND g.start_pos + g.length - 1
  GROUP BY g.device_id, g.phase, g.start_pos, g.length""", SEGF)
add("count_rule", SEGS, """
  SELECT device_id, b AS baseline_segments, m AS movement_segments, b = 0 AS baseline_correct, m > 0 AS movement_correct,
    ((b = 0)::INTEGER + (m > 0)::INTEGER) / 2.0 * 100 AS accuracy
  FROM (SELECT d.device_id, count(*) FILTER (g.phase = 'BASELINE') AS b, count(*) FILTER (g.phase = 'MOVEMENT') AS m
    FROM (SELECT DISTINCT device_id FROM packets) d LEFT JOIN sg g USING (device_id) GROUP BY d.device_id)""", "accuracy")
add("segment_split", SEGS, """
  SELECT phase, n, greatest(floor(n * 0.3 + 0.5), CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS n_test, n - greatest(floor(n * 0.3 + 0.5), CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS n_train
  FROM (SELECT phase, count(*) AS n FROM sg GROUP BY phase)""")
GRID_W = (10, 15, 20, 25, 30)


def grid(ks, mins, caps) -> list[str]:
    rows, i = [], 0
    for k in ks:
        for w in GRID_W:
            for mn in mins:
                for mx in caps:
                    rows.append(f"({i}, {k}::DOUBLE, {w}, {mn}, {mx})")
                    i += 1
    return [PACKETS, TURB, "mov AS MATERIALIZED (" + " UNION ALL ".join(moving(w) for w in GRID_W) + ")", LEVELS,
            f"grid AS (SELECT * FROM (VALUES {', '.join(rows)}) v(combo, k, w, min_length, cap))",
            """gin AS (SELECT m.*, c.k, c.cap, l.mean_variance + c.k * l.std_variance AS thr
              FROM mov m JOIN lev l USING (device_id, w) JOIN (SELECT DISTINCT k, w, cap FROM grid) c ON c.w = m.w)""",
            *segs("gin", "device_id, phase, k, w, cap"),
            """gr AS MATERIALIZED (SELECT s.device_id, g.combo::INTEGER AS combo, g.k, g.w::INTEGER AS "window", g.min_length::INTEGER AS min_length,
                g.cap::INTEGER AS max_length,
                coalesce(sum(len(list_filter(o, lambda e: e.ln >= g.min_length))) FILTER (phase = 'BASELINE'), 0)::BIGINT AS fp,
                coalesce(sum(len(list_filter(o, lambda e: e.ln >= g.min_length))) FILTER (phase = 'MOVEMENT'), 0)::BIGINT AS tp
              FROM grid g JOIN seg s ON s.k = g.k AND s.w = g.w AND s.cap = g.cap GROUP BY ALL)""",
            """gs AS MATERIALIZED (SELECT * EXCLUDE (fp, tp), fp AS false_positives, tp AS true_positives,
                (least(tp, 7) - 10 * fp - 0.5 * (CASE WHEN tp > 0 THEN abs(tp - 5) ELSE 10 END))::DOUBLE AS score FROM gr)"""]


add("grid_search", grid((0.0, 0.5, 1.0, 1.5, 2.0), (2, 5, 10, 15), (10, 20, 40)), "SELECT * FROM gs", "k score")
add("grid_top", grid((1.5, 2.0, 2.5, 3.0, 3.5), (5, 10, 15, 20), (40, 60, 80)), """
  SELECT device_id, rank::INTEGER AS rank, combo, false_positives, true_positives, score, rank = 1 AND score > -1 AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY score DESC, combo) AS rank FROM gs) WHERE rank <= 5""", "score")

# --- evaluation --------------------------------------------------------------------------

WARM = """warm AS MATERIALIZED (SELECT l.* FROM flong l JOIN (SELECT device_id, seq, row_number() OVER (
    PARTITION BY device_id, phase ORDER BY ts, seq) AS rn FROM feats) r USING (device_id, seq) WHERE rn > 10)"""
add("warmup_skip", [PACKETS], """SELECT device_id, phase, seq FROM (SELECT *, row_number() OVER (
    PARTITION BY device_id, phase ORDER BY ts, seq) AS rn FROM packets) WHERE rn > 10""")


def otsu(src: str) -> list[str]:
    """Every one of the 99 candidates against every value."""
    return [f"rng AS (SELECT device_id, feature_idx, feature, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 100 AS step FROM {src} GROUP BY ALL)",
            f"""cand AS MATERIALIZED (SELECT v.device_id, v.feature_idx, v.feature, i, r.lo + i * r.step AS thr, count(*) AS n,
                count(*) FILTER (value < r.lo + i * r.step) AS n0, avg(value) FILTER (value < r.lo + i * r.step) AS mu0,
                avg(value) FILTER (value >= r.lo + i * r.step) AS mu1
              FROM {src} v JOIN rng r USING (device_id, feature_idx, feature), range(1, 100) c(i) GROUP BY ALL)""",
            """spr AS (SELECT *, (n0 / n) * ((n - n0) / n) * pow(mu0 - mu1, 2) AS spread FROM cand WHERE n0 > 0 AND n0 < n)""",
            """opt AS MATERIALIZED (SELECT device_id, feature_idx, feature, min_by(thr, i) AS threshold FROM (
                SELECT *, max(spread) OVER (PARTITION BY device_id, feature_idx) AS top FROM spr) WHERE spread > 0 AND spread >= top * (1 - 1e-9) GROUP BY ALL)""",
            """thr AS MATERIALIZED (SELECT r.device_id, r.feature_idx, r.feature, coalesce(o.threshold, (r.lo + r.hi) / 2) AS threshold
              FROM rng r LEFT JOIN opt o USING (device_id, feature_idx))""",
            f"""cm AS MATERIALIZED (SELECT v.device_id, v.feature_idx::INTEGER AS feature_idx, v.feature,
                count(*) FILTER (phase = 'MOVEMENT' AND value >= threshold) AS tp, count(*) FILTER (phase <> 'MOVEMENT' AND value < threshold) AS tn,
                count(*) FILTER (phase <> 'MOVEMENT' AND value >= threshold) AS fp, count(*) FILTER (phase = 'MOVEMENT' AND value < threshold) AS fn
              FROM {src} v JOIN thr t USING (device_id, feature_idx) GROUP BY ALL)""",
            """met AS MATERIALIZED (SELECT *, CASE WHEN p / 100 + r / 100 > 0 THEN 2.0 * ((p / 100.0) * (r / 100.0)) / (p / 100.0 + r / 100.0) * 100.0 ELSE 0.0 END AS f1
              FROM (SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) * 100.0 AS accuracy, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) * 100.0 ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) * 100.0 ELSE 0.0 END AS r, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) * 100.0 ELSE 0.0 END AS specificity,
                CASE WHEN tn + fp > 0 THEN fp::DOUBLE / (tn + fp) * 100.0 ELSE 0.0 END AS fp_rate, CASE WHEN tp + fn > 0 THEN fn::DOUBLE / (tp + fn) * 100.0 ELSE 0.0 END AS fn_rate FROM cm))"""]


EVAL = [*BASE, LONG, WARM, *otsu("warm")]
add("otsu", EVAL, "SELECT device_id, feature_idx::INTEGER AS feature_idx, feature, threshold FROM thr", "threshold")
add("confusion", EVAL, """
  SELECT device_id, feature_idx, feature, tp, tn, fp, fn, accuracy, p AS precision, r AS recall, specificity, f1, fp_rate, fn_rate,
    CASE WHEN fp_rate > fn_rate THEN fp_rate / (fn_rate + 0.01) ELSE fn_rate / (fp_rate + 0.01) END AS balance FROM met""",
    "accuracy precision recall specificity f1 fp_rate fn_rate balance")


def rank(c: str) -> str:
    return f"(row_number() OVER (PARTITION BY device_id ORDER BY {c} DESC, feature_idx))::INTEGER"


add("feature_ranking", EVAL, f"""
  SELECT device_id, feature_idx, accuracy, f1, {rank('accuracy')} AS accuracy_rank, {rank('f1')} AS f1_rank FROM met""", "accuracy f1")
add("best_features", EVAL, "SELECT device_id, " + ", ".join(
    f"first(feature ORDER BY {c}, feature_idx) AS {n}" for c, n in (
        ("accuracy DESC", "best_accuracy"), ("f1 DESC", "best_f1"), ("specificity DESC", "best_specificity"),
        ("r DESC", "best_recall"), ("fp + fn", "fewest_errors"))) + " FROM met GROUP BY device_id")

# --- spectra and subcarriers -------------------------------------------------------------

SUB = f"""sub AS MATERIALIZED (SELECT device_id, phase, seq, (unnest(range(0, len(iq) // 2)))::INTEGER AS sc, unnest({amps('iq')}) AS amp FROM packets)"""
SCF = """scf AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY fisher DESC, sc))::INTEGER AS rank FROM (
    SELECT *, CASE WHEN baseline_var + movement_var > 1e-6 THEN pow(movement_mean - baseline_mean, 2) / (baseline_var + movement_var) ELSE 0.0 END AS fisher,
      CASE WHEN baseline_var > 1e-6 THEN movement_var / baseline_var ELSE 1.0 END AS variance_ratio, abs(movement_mean - baseline_mean) AS mean_diff
    FROM (SELECT device_id, sc, avg(amp) FILTER (phase = 'BASELINE') AS baseline_mean, avg(amp) FILTER (phase = 'MOVEMENT') AS movement_mean,
        var_pop(amp) FILTER (phase = 'BASELINE') AS baseline_var, var_pop(amp) FILTER (phase = 'MOVEMENT') AS movement_var FROM sub GROUP BY device_id, sc)))"""
add("subcarrier_fisher", [PACKETS, SUB, SCF], "SELECT * FROM scf WHERE rank <= 15",
    "baseline_mean movement_mean baseline_var movement_var fisher variance_ratio mean_diff")
add("zone_fisher", [PACKETS, SUB, SCF, """z AS (SELECT device_id, CASE WHEN sc < 10 THEN 'low' WHEN sc < 25 THEN 'middle' ELSE 'high' END AS zone,
    count(*) AS subcarriers, sum(fisher) AS total_fisher, avg(fisher) AS avg_fisher FROM scf GROUP BY ALL)""",
    "al AS (SELECT device_id, sum(fisher) AS t, avg(fisher) AS a FROM scf GROUP BY device_id)"],
    "SELECT z.*, total_fisher / t * 100 AS total_pct, avg_fisher / a * 100 AS avg_pct FROM z JOIN al USING (device_id)",
    "total_fisher avg_fisher total_pct avg_pct")
add("best_range", [PACKETS, SUB, SCF, """rg AS (SELECT a.device_id, a.sc AS range_start, w, avg(b.fisher) AS f FROM scf a, (VALUES (6), (10), (15), (20), (30)) v(w), scf b
    WHERE b.device_id = a.device_id AND b.sc >= a.sc AND b.sc < a.sc + w GROUP BY ALL HAVING count(*) = w)"""],
    """SELECT device_id, range_start, (range_start + w)::INTEGER AS range_end, f AS avg_fisher FROM (
        SELECT *, max(f) OVER (PARTITION BY device_id) AS top FROM rg)
      WHERE f >= top * (1 - 1e-12) QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY w, range_start) = 1""", "avg_fisher")
COV = """cov AS MATERIALIZED (SELECT a.device_id, a.sc AS i, b.sc AS j, covar_samp(a.amp, b.amp) AS cov FROM sub a JOIN sub b
    ON a.device_id = b.device_id AND a.seq = b.seq AND a.sc <= b.sc WHERE a.phase = 'MOVEMENT' GROUP BY ALL)"""
add("covariance", [PACKETS, SUB, COV], "SELECT * FROM cov", "cov")
add("covariance_mixed", [PACKETS, MIXED, SUB.replace("FROM packets", "FROM mixed")], """
  SELECT a.device_id, a.sc AS i, b.sc AS j, covar_samp(a.amp, b.amp) AS cov, count(*) AS packets FROM sub a JOIN sub b
    ON a.device_id = b.device_id AND a.seq = b.seq AND a.sc <= b.sc WHERE a.phase = 'MOVEMENT' GROUP BY ALL HAVING count(*) > 1""", "cov")

POWER = """list_reduce(range(0, 50), lambda acc, k: list_transform([list_transform(m, lambda row: list_dot_product(row, acc.v))], lambda u:
    {'v': list_transform(u, lambda e: e / sqrt(list_dot_product(u, u))), 'e': list_dot_product(acc.v, u) / list_dot_product(acc.v, acc.v)})[1],
    {'v': list_transform(range(0, len(m)), lambda k: 1 / sqrt(len(m)::DOUBLE)), 'e': 0.0::DOUBLE})"""
DEFLATED = """list_transform(range(1, len(p.m) + 1), lambda a: list_transform(range(1, len(p.m) + 1),
    lambda b: p.m[a][b] - p.r.e * p.r.v[a] * p.r.v[b]))"""
PCA = [PACKETS, SUB, COV,
       "full_cov AS (SELECT device_id, i, j, cov FROM cov UNION ALL SELECT device_id, j, i, cov FROM cov WHERE i < j)",
       "mrow AS (SELECT device_id, i, list(cov ORDER BY j) AS l FROM full_cov GROUP BY device_id, i)",
       "mat AS (SELECT device_id, list(l ORDER BY i) AS m FROM mrow GROUP BY device_id)",
       f"""pc AS (SELECT device_id, 1 AS pc, m, {POWER} AS r FROM mat UNION ALL
         SELECT device_id, pc + 1, m, {POWER} AS r FROM (SELECT p.device_id, p.pc, {DEFLATED} AS m FROM pc p WHERE p.pc < 6))""",
       """pcs AS (SELECT pc.device_id, pc.pc, pc.r.e AS eigenvalue, pc.r.v AS v, pc.r.e / t.tr * 100 AS explained_pct FROM pc JOIN (
         SELECT device_id, sum(cov) AS tr FROM cov WHERE i = j GROUP BY device_id) t USING (device_id))""",
       "pcc AS (SELECT *, sum(explained_pct) OVER (PARTITION BY device_id ORDER BY pc) AS cumulative_pct FROM pcs)"]
add("pca", PCA, """SELECT device_id, pc::INTEGER AS pc, eigenvalue, explained_pct, cumulative_pct,
    coalesce(max(CASE WHEN cumulative_pct < 95 THEN pc END) OVER (PARTITION BY device_id), 0)::INTEGER AS components_for_95 FROM pcc""",
    "eigenvalue explained_pct cumulative_pct", recursive=True)
add("pca_loadings", PCA, """SELECT device_id, pc::INTEGER AS pc, (row_number() OVER (PARTITION BY device_id, pc ORDER BY abs(w) DESC, sc))::INTEGER AS rank, sc, abs(w) AS weight
    FROM (SELECT device_id, pc, (unnest(range(0, len(v))))::INTEGER AS sc, unnest(v) AS w FROM pcs) QUALIFY rank <= 3""", "weight", recursive=True)

DOP = [PACKETS,
       f"da AS (SELECT device_id, phase, list_avg({amps('iq')}) AS a, row_number() OVER (PARTITION BY device_id, phase ORDER BY ts, seq) - 1 AS p, "
       "count(*) OVER (PARTITION BY device_id, phase) AS n FROM packets)",
       """dfr AS (SELECT * FROM (SELECT *, list(a) OVER (PARTITION BY device_id, phase ORDER BY p ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS f FROM da)
         WHERE p >= 63 AND (p % 32 = 0 OR p = n - 1))""",
       """dhn AS (SELECT device_id, phase, p, list_transform(range(0, 64), lambda t: f[t+1] * 0.5 * (1 - cos(2 * pi() * t / 63))) AS h FROM dfr)""",
       """dm AS (SELECT device_id, phase, p, list_transform(range(0, 32), lambda k: sqrt(
           pow(list_sum(list_transform(range(0, 64), lambda t: h[t+1] * cos(2 * pi() * k * t / 64))), 2)
         + pow(list_sum(list_transform(range(0, 64), lambda t: h[t+1] * sin(2 * pi() * k * t / 64))), 2))) AS m FROM dhn)""",
       """dop AS MATERIALIZED (SELECT device_id, phase, p AS frame_end, len(list_filter(m, lambda v: v > 0.1 * list_max(m))) * 50.0 / 64 AS doppler_spread,
           sqrt(list_sum(list_transform(range(0, 32), lambda k: m[k+1] * pow(k * 50.0 / 64 - c, 2))) / list_sum(m)) AS rms_doppler_spread,
           list_max(m) AS peak_doppler, c AS spectral_centroid
         FROM (SELECT *, list_sum(list_transform(range(0, 32), lambda k: m[k+1] * k * 50.0 / 64)) / list_sum(m) AS c FROM dm WHERE list_sum(m) >= 1e-6))"""]
add("doppler_features", DOP, "SELECT device_id, phase, frame_end, doppler_spread, rms_doppler_spread, peak_doppler, spectral_centroid FROM dop",
    " ".join(DOPPLER))
DLONG = "dlong AS (" + " UNION ALL ".join(
    f"SELECT device_id, phase, {i} AS feature_idx, '{f}' AS feature, {f}::DOUBLE AS value FROM dop" for i, f in enumerate(DOPPLER)) + ")"
add("doppler_ranking", [*DOP, DLONG, *otsu("dlong")], f"""
  SELECT device_id, feature, tp, tn, fp, fn, accuracy, f1, {rank('accuracy')} AS accuracy_rank FROM met""", "accuracy f1")

# --- control and stores ------------------------------------------------------------------

add("capture_log_roundtrip", [PACKETS], """
  SELECT phase, len(iq)::INTEGER AS n_values, count(*) AS lines, sum(list_sum(iq))::BIGINT AS total,
    sum(list_sum(list_transform(iq, lambda v: v * v)))::BIGINT AS total_sq FROM packets GROUP BY ALL""")
add("capture_lines", [PACKETS], "SELECT 'CSI|' || phase || '|' || array_to_string(iq[1:128], ',') AS value FROM packets")

COMMANDS = """cmds AS MATERIALIZED (SELECT user_id AS device_id, event_id AS seq, ts, CASE event_type
      WHEN 'click' THEN '{"cmd":"threshold","value":' || (k / 100.0::DOUBLE) || '}'
      WHEN 'view' THEN '{"cmd":"debounce","value":' || (k % 12) || '}'
      WHEN 'purchase' THEN '{"cmd":"persistence","value":' || (k % 40) || '}'
      WHEN 'signup' THEN CASE WHEN k = 0 THEN '{"cmd":"factory_reset"}' ELSE '{"cmd":"hysteresis","value":' || (k / 80.0::DOUBLE) || '}' END
      ELSE CASE k % 4 WHEN 0 THEN '{"cmd":"self_destruct"}' WHEN 1 THEN '{"value":1}' WHEN 2 THEN '{oops' ELSE '{"cmd":"logs","enabled":true}' END END AS message
    FROM (SELECT *, (props::JSON ->> 'k')::BIGINT AS k FROM events))"""
PARSED = """parsed AS (SELECT *, CASE WHEN json_valid(message) THEN message::JSON ->> 'cmd' END AS cmd,
      CASE WHEN json_valid(message) THEN (message::JSON ->> 'value')::DOUBLE END AS value, json_valid(message) AS ok FROM cmds)"""
VALID = """val AS MATERIALIZED (SELECT *, CASE cmd WHEN 'threshold' THEN 'float' WHEN 'hysteresis' THEN 'float' WHEN 'debounce' THEN 'int'
      WHEN 'persistence' THEN 'int' WHEN 'logs' THEN 'bool' WHEN 'factory_reset' THEN 'reset' END AS kind,
    CASE WHEN NOT ok THEN 'ERROR: Invalid JSON' WHEN cmd IS NULL THEN 'ERROR: Missing ''cmd'' field'
      WHEN cmd = 'self_destruct' THEN 'ERROR: Unknown command ''self_destruct'''
      WHEN cmd = 'threshold' AND NOT value BETWEEN 0.15::DOUBLE AND 0.80::DOUBLE THEN 'ERROR: Threshold must be between 0.15 and 0.80'
      WHEN cmd = 'hysteresis' AND NOT value BETWEEN 0.1::DOUBLE AND 1.0::DOUBLE THEN 'ERROR: Hysteresis ratio must be between 0.1 and 1.0'
      WHEN cmd = 'debounce' AND NOT value BETWEEN 1 AND 10 THEN 'ERROR: Debounce count must be between 1 and 10'
      WHEN cmd = 'persistence' AND NOT value BETWEEN 1 AND 30 THEN 'ERROR: Persistence timeout must be between 1 and 30 seconds'
      ELSE '' END AS error FROM parsed)"""
CMD = [COMMANDS, PARSED, VALID]
add("commands_validated", CMD, """
  SELECT device_id, seq, coalesce(cmd, '') AS cmd, coalesce(kind, '') AS kind, error = '' AS accepted, CASE WHEN error = '' AND cmd <> 'factory_reset'
    THEN CASE WHEN cmd = 'logs' THEN 1.0 ELSE value END END AS setting, error FROM val""", "setting")



def last(cmd: str, value: str, default: float) -> str:
    return (f"coalesce(last_value(CASE WHEN cmd = 'factory_reset' THEN {default}::DOUBLE WHEN cmd = '{cmd}' THEN {value} END IGNORE NULLS) "
            f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {default}::DOUBLE)")


HIST = [*CMD, f"""hist AS MATERIALIZED (SELECT device_id, seq, ts AS vf, lead(ts) OVER ({W}) AS vt, {last('threshold', 'value', 0.5)} AS threshold,
    {last('debounce', 'value', 10)} AS debounce_count, {last('persistence', 'value', 3)} AS persistence_timeout,
    {last('hysteresis', 'value', 0.7)} AS hysteresis_ratio, {last('logs', '1.0', 1)} AS csi_logs_enabled FROM val WHERE error = '')"""]


def before(cmd: str, value: str, default: float) -> str:
    return last(cmd, value, default).replace("AND CURRENT ROW", "AND 1 PRECEDING")


add("command_responses", [*CMD, f"""old AS (SELECT *, {before('threshold', 'value', 0.5)} AS o_t, {before('debounce', 'value', 10)} AS o_d,
    {before('persistence', 'value', 3)} AS o_p, {before('hysteresis', 'value', 0.7)} AS o_h FROM val WHERE error = '')"""], """
  SELECT device_id, seq, '{"response":"' || CASE cmd
      WHEN 'threshold' THEN printf('Threshold updated: %.4f -> %.4f', o_t, value)
      WHEN 'debounce' THEN printf('Debounce count updated: %d -> %d', o_d::BIGINT, value::BIGINT)
      WHEN 'persistence' THEN printf('Persistence timeout updated: %d -> %d seconds', o_p::BIGINT, value::BIGINT)
      WHEN 'hysteresis' THEN printf('Hysteresis ratio updated: %.2f -> %.2f', o_h, value)
      WHEN 'logs' THEN 'CSI logs enabled' WHEN 'factory_reset' THEN '✅ Factory reset complete - all settings restored to defaults' END || '"}' AS response FROM old
  UNION ALL SELECT device_id, seq, '{"response":"' || error || '"}' FROM val WHERE error <> ''""")
add("config_history", HIST, """
  SELECT device_id, seq, epoch_us(vf) AS valid_from, coalesce(epoch_us(vt), -1) AS valid_to, threshold, debounce_count, persistence_timeout, hysteresis_ratio,
    csi_logs_enabled, threshold * hysteresis_ratio AS threshold_low, 20.0 AS packet_rate FROM hist""",
    "threshold debounce_count persistence_timeout hysteresis_ratio csi_logs_enabled threshold_low packet_rate")
add("config_asof", [SERIES, *HIST], """
  SELECT s.device_id, s.seq, s.score, coalesce(h.threshold, 0.5::DOUBLE) AS threshold, coalesce(h.debounce_count, 10) AS debounce_count,
    coalesce(h.persistence_timeout, 3) AS persistence_timeout, s.score > coalesce(h.threshold, 0.5::DOUBLE) AS above
  FROM series s ASOF LEFT JOIN hist h ON s.device_id = h.device_id AND s.ts >= h.vf""",
    "score threshold debounce_count persistence_timeout")
STORED = """stored AS (SELECT event_id AS device_id, (CASE WHEN event_id % 9 = 4 THEN 2 ELSE 1 END)::INTEGER AS version, value / 100 AS threshold,
    (event_id % 13)::DOUBLE AS debounce_count, value / 90 AS hysteresis_ratio, (event_id % 35)::DOUBLE AS persistence_timeout,
    CASE WHEN event_id % 50 = 7 THEN 'nan'::DOUBLE ELSE value / 9 END AS hampel_threshold, (event_id % 14)::DOUBLE AS savgol_window_size,
    (event_id % 5)::DOUBLE AS wavelet_level, value / 40 AS wavelet_threshold FROM events)"""
RULES = (("threshold", "threshold > 0 AND threshold < 1", 0.43), ("debounce_count", "debounce_count BETWEEN 1 AND 10", 3.0),
         ("hysteresis_ratio", "hysteresis_ratio >= 0.1::DOUBLE AND hysteresis_ratio <= 1", 0.7),
         ("persistence_timeout", "persistence_timeout BETWEEN 1 AND 30", 3.0),
         ("hampel_threshold", "NOT isnan(hampel_threshold) AND hampel_threshold BETWEEN 1 AND 10", 2.0),
         ("savgol_window_size", "savgol_window_size IN (3, 5, 7, 9, 11)", 5.0), ("wavelet_level", "wavelet_level BETWEEN 1 AND 3", 3.0),
         ("wavelet_threshold", "wavelet_threshold >= 0.5::DOUBLE AND wavelet_threshold <= 2", 1.0))
FIXED = ["rep AS (SELECT device_id, version, " + ", ".join(f"CASE WHEN {ok} THEN {c} ELSE {v}::DOUBLE END AS {c}" for c, ok, v in RULES)
         + ", concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({ok}) THEN '{c}' END" for c, ok, _ in RULES) + ") AS repaired, version = 1 AS usable FROM stored)"]
add("config_repair", [STORED, *FIXED], "SELECT * FROM rep", " ".join(c for c, _, _ in RULES))
add("config_checks", [STORED], """
  SELECT device_id, d AS debounce_ok, h AS hysteresis_ok, p AS persistence_ok, d AND h AND p AS valid FROM (SELECT device_id,
    debounce_count BETWEEN 1 AND 10 AS d, hysteresis_ratio >= 0.1::DOUBLE AND hysteresis_ratio <= 1 AS h, persistence_timeout BETWEEN 1 AND 30 AS p FROM stored)""")
add("config_store", [STORED, *FIXED], "SELECT device_id, threshold, hampel_threshold, savgol_window_size FROM rep WHERE usable",
    "threshold hampel_threshold savgol_window_size")
LAST100 = """l100 AS (SELECT device_id, list_sort(list(score)) AS s, count(*) AS n, min(score) AS mn, max(score) AS mx, avg(score) AS av, stddev_pop(score) AS sd
    FROM (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) <= 100) GROUP BY device_id)"""
NOW = "now_ AS (SELECT * FROM hist WHERE vt IS NULL)"
add("status_reports", [SERIES, *HIST, LAST100, NOW], f"""
  SELECT l.device_id, n AS count, mn AS min, mx AS max, av AS avg, sd AS stddev,
    {', '.join(f'CASE WHEN n >= 50 THEN {pct(p)} END AS p{p}' for p in (25, 50, 75, 95))},
    CASE WHEN n >= 50 THEN ({pct(50)} + {pct(75)}) / 2 END AS recommended_threshold,
    coalesce(threshold, 0.5::DOUBLE) AS current_threshold, coalesce(debounce_count, 10) AS current_debounce_count,
    coalesce(persistence_timeout, 3) AS current_persistence_timeout, coalesce(hysteresis_ratio, 0.7::DOUBLE) AS current_hysteresis_ratio,
    CASE WHEN n < 50 THEN 'ERROR: Need at least 50 samples (have ' || n || ')' ELSE '' END AS error
  FROM l100 l LEFT JOIN now_ h USING (device_id)""",
    "min max avg stddev p25 p50 p75 p95 recommended_threshold current_threshold current_debounce_count current_persistence_timeout current_hysteresis_ratio")
add("info_reports", [*HIST, NOW], """
  SELECT d.device_id, coalesce(threshold, 0.5::DOUBLE) AS threshold, coalesce(debounce_count, 10)::INTEGER AS debounce,
    coalesce(persistence_timeout, 3)::INTEGER AS persistence_timeout, coalesce(hysteresis_ratio, 0.7::DOUBLE) AS hysteresis_ratio,
    20 AS traffic_generator_rate, false AS hampel_enabled, 3 AS wavelet_level, coalesce(csi_logs_enabled, 1) > 0 AS csi_logs_enabled
  FROM (SELECT DISTINCT user_id AS device_id FROM events) d LEFT JOIN now_ n ON n.device_id = d.device_id""",
    "threshold hysteresis_ratio")

# --- streams: the batch meaning ----------------------------------------------------------

ORACLES["stream_detections"] = ORACLES["motion_detections"]
ORACLES["stream_capture"] = ORACLES["capture_lines"]
add("stream_series_detections", SERIES_ST, "SELECT device_id, seq, state FROM st")
PKT_GATE = [
    "sg_l AS (SELECT device_id, list({'seq': seq, 'ms': epoch_us(ts) // 1000, 's': state, 'v': score} ORDER BY ts, seq) AS rows FROM st GROUP BY device_id)",
    """sg_f AS (SELECT device_id, unnest(list_reduce(rows, lambda acc, r: CASE
          WHEN acc.t IS NULL OR r.s <> acc.s OR abs(r.v - acc.v) > 0.05 OR r.ms - acc.t >= 500
          THEN {'t': r.ms, 's': r.s, 'v': r.v, 'o': list_append(acc.o, {'seq': r.seq, 's': r.s, 'p': true})}
          ELSE {'t': acc.t, 's': acc.s, 'v': acc.v, 'o': list_append(acc.o, {'seq': r.seq, 's': r.s, 'p': false})} END,
          {'t': NULL::BIGINT, 's': ''::VARCHAR, 'v': 0.0::DOUBLE, 'o': []::STRUCT(seq BIGINT, s VARCHAR, p BOOLEAN)[]}).o) AS r FROM sg_l)"""]
add("stream_publish", [*DETECTIONS, *PKT_GATE], "SELECT device_id, r.seq AS seq, r.s AS state, r.p AS published FROM sg_f")
add("stream_packet_rate", [PACKETS], """
  SELECT device_id, floor(epoch_us(ts) / 1000000)::BIGINT AS second, count(*) AS received FROM packets GROUP BY ALL""")
add("stream_ticks", [*SERIES_ST, *LIVE_TICKS], "SELECT device_id, us AS ts, state, score, confidence FROM tick", "score confidence")
add("stream_idle_resets", [*SERIES_ST, *LIVE_TICKS, *RESET_TICKS], "SELECT device_id, us AS reset_ts, n AS resets FROM rt")
add("stream_inactivity_alerts", SERIES_ST, f"""
  SELECT device_id, epoch_us(lo) AS idle_since, epoch_us(lo + INTERVAL 4 HOUR) AS alert_ts
  FROM (SELECT *, lead(ts) OVER ({W}) AS until, ts AS lo FROM (SELECT *, state IS DISTINCT FROM lag(state) OVER ({W}) AS chg FROM st) WHERE chg)
  WHERE state = 'IDLE' AND hour(lo + INTERVAL 4 HOUR) BETWEEN 8 AND 21 AND (until >= lo + INTERVAL 4 HOUR
    OR until IS NULL AND epoch_us(lo + INTERVAL 4 HOUR) < (SELECT (floor(max(epoch_us(ts)) / {H * 1e6}) + 2) * {H * 1000000} FROM st))""")
ORACLES["stream_phases"] = ORACLES["phase_assignment"]
ORACLES["stream_phase_events"] = ORACLES["phase_events"]
ORACLES["stream_config_asof"] = ORACLES["config_asof"]
# One packet in 47 comes after all others: it is late if its second was given, and all seconds of its device up to the watermark were.
add("stream_late", [PACKETS, "p AS (SELECT device_id, (epoch_us(ts) // 1000000 + 1) * 1000000 AS ends, epoch_us(ts) AS us, seq % 47 = 7 AS delayed FROM packets)",
                    """given AS (SELECT device_id, max(ends) AS upto FROM p WHERE NOT delayed AND ends <= (SELECT max(us) - 10000000 FROM p WHERE NOT delayed) GROUP BY device_id)"""], """
  SELECT p.device_id, count(*) AS received, count(*) FILTER (delayed AND ends <= upto) AS late FROM p LEFT JOIN given g ON g.device_id = p.device_id GROUP BY p.device_id""")
