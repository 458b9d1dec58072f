"""Named queries over the given tables, one or more per operator.

Times are given as BIGINT (microseconds or seconds) and doubles rounded to six digits so
that results compare exactly with other engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import kernels as Q
from rfsense.functions import packet as P
from rfsense.functions import scalar as S
from rfsense.operators import calibrate as C
from rfsense.operators import control as M
from rfsense.operators import detect as D
from rfsense.operators import evaluate as E
from rfsense.operators import publish as B
from rfsense.operators import recurrence as R
from rfsense.operators import segment as G
from rfsense.operators import sessions as N
from rfsense.operators import spectral as X
from rfsense.operators import wavelet as V
from rfsense.operators import windows as W
from rfsense.operators.features import features, long_form, with_previous
from rfsense.operators.forest import segment_forest, split
from rfsense.operators.layout import arrange, measure
from rfsense.plans import pipelines as L
from rfsense.plans.pipelines import rounded
from rfsense.session import materialise, ship, workdir
from rfsense.sources import capture_log, stores, tables
from rfsense.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOUR = 3600


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times without a zone
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def us(c: str) -> F.Column:
    return F.unix_micros(c).alias(c)


def mixed_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of three lengths, some too short to be admitted."""
    n = F.when(F.col("seq") % 7 == 3, 40).when(F.col("seq") % 11 == 5, 8).otherwise(64)
    return tables.packets(spark, sf).withColumn("iq", F.slice("iq", 1, n))


# --- packets and features ---------------------------------------------------------------

@query
def packet_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ("variance", "entropy", "iqr", "spatial_variance", "spatial_correlation", "spatial_gradient")
    return rounded(features(mixed_packets(spark, sf), names, keep=()).drop("ts"))


@query
def packet_features_band(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(tables.packets(spark, sf), ("variance", "iqr", "spatial_gradient"), 20, 30, keep=()).drop("ts"))


@query
def packet_amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    band = P.analysis_band(F.col("iq"))
    return rounded(tables.packets(spark, sf).select(
        "device_id", "seq", Q.feature_struct(F.col("iq").cast("array<int>"), ["mean_amplitude"])["mean_amplitude"].alias("mean_amplitude"),
        Q.feature_struct(band, ["turbulence"])["turbulence"].alias("spatial_turbulence"), F.size(band).alias("band_values")))


@query
def packet_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """The packet features as plain column expressions, for use inside SQL."""
    x = mixed_packets(spark, sf).where(P.admitted(F.col("iq"))).select(
        "device_id", "seq", P.select_subcarriers(F.col("iq")).alias("x")).withColumn("_d", P.adjacent_diffs(F.col("x")))
    return rounded(x.select("device_id", "seq", *[e.alias(n) for n, e in P.packet_columns(F.col("x"), F.col("_d")).items()]))


@query
def subcarrier_amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.subcarriers(tables.packets(spark, sf)))


@query
def temporal_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(tables.packets(spark, sf), ("temporal_delta_mean", "temporal_delta_variance"), keep=()).drop("ts"))


@query
def temporal_deltas_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(mixed_packets(spark, sf), ("temporal_delta_mean", "temporal_delta_variance"), keep=()).drop("ts"))


@query
def moving_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(tables.packets(spark, sf), ("skewness", "kurtosis"), keep=()).drop("ts"))


@query
def features_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(long_form(features(tables.packets(spark, sf)), ("device_id", "seq", "phase")))


# --- scalar series ----------------------------------------------------------------------

@query
def hampel(spark: SparkSession, sf: str) -> DataFrame:
    lay = arrange(tables.series(spark, sf), before=K.HAMPEL_ROWS - 1)
    return rounded(lay.done(W.hampel(lay.df, "x", "filtered", lay)).select("device_id", "seq", "filtered"))


@query
def savgol(spark: SparkSession, sf: str) -> DataFrame:
    lay = arrange(tables.series(spark, sf), before=4)
    return rounded(lay.done(lay.df.withColumn("smoothed", W.savgol_or_mean(F.col("x"), lay))).select(
        "device_id", "seq", "smoothed"))


@query
def moving_variance(spark: SparkSession, sf: str) -> DataFrame:
    lay = arrange(tables.series(spark, sf), before=19)
    df = lay.df.withColumn("_p", lay.pos())
    return rounded(lay.done(df.withColumn("mv", W.moving_variance(F.col("x"), lay, 20, F.col("_p")))).select(
        "device_id", "seq", "mv"))


@query
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    lay = arrange(tables.series(spark, sf), before=K.STATS_ROWS - 1)
    s = W.rolling_stats(F.col("x"), lay)
    return rounded(lay.done(lay.df.select("*", *[c.alias(f"x_{n}") for n, c in s.items()])).select(
        "device_id", "seq", *[f"x_{n}" for n in s]))


@query
def rolling_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    lay = arrange(tables.series(spark, sf), before=K.STATS_ROWS - 1)
    df = lay.done(lay.df.withColumn("_f", W.sorted_frame(F.col("score"), lay)))
    f = F.col("_f")
    return rounded(df.select("device_id", "seq", *[W.percentile_lower(f, p).alias(f"p{p}") for p in (25, 50, 75, 95)],
                             W.recommended_threshold(f).alias("recommended_threshold")))


@query
def lowpass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.lowpass(tables.series(spark, sf), "x").select("device_id", "seq", "lowpass"))


@query
def lowpass_big(spark: SparkSession, sf: str) -> DataFrame:
    big = tables.series_big(spark, sf)
    out = R.lowpass(big, "x", order=tables.SERIES_BIG_ORDER)
    return rounded(out.select("device_id", "seq", "l_linenumber", "l_partkey", "l_quantity", "lowpass"), 3)


@query
def ewma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.ewma(tables.series(spark, sf), "x").select(
        "device_id", "seq", "ewma_mean", "ewma_variance", "ewma_stddev"))


@query
def ewma_reset(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.normaliser_with_idle_reset(tables.series(spark, sf), 0.53, 2, 6 * HOUR, 24 * HOUR, period_seconds=HOUR).select(
        "device_id", "seq", "epoch", "ewma_mean", "ewma_variance"))


@query
def filter_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.cascade(tables.series(spark, sf), "x").select("device_id", "seq", "filtered", "ewma_mean", "ewma_variance"))


@query
def wavelet_sliding(spark: SparkSession, sf: str) -> DataFrame:
    lay = arrange(tables.series(spark, sf), before=K.WAVELET_ROWS)
    df = lay.df.withColumn("_p", lay.pos())
    df = df.withColumn("denoised", V.sliding(F.col("x"), lay, F.col("_p"), threshold=20.0))
    return rounded(lay.done(df).select("device_id", "seq", "denoised"))


@query
def wavelet_block(spark: SparkSession, sf: str) -> DataFrame:
    b = V.blocks(tables.series(spark, sf), "x", 32, 2, 20.0, "soft")
    return rounded(b.select("device_id", "block", F.posexplode("denoised").alias("i", "value")))


@query
def wavelet_block_as_coded(spark: SparkSession, sf: str) -> DataFrame:
    b = V.blocks(tables.series(spark, sf), "x", 32, 1, 20.0, "hard", mode="as_coded")
    return rounded(b.select("device_id", "block", F.posexplode("denoised").alias("i", "value")))


@query
def shrinkage(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("x") - 60.0
    return rounded(tables.series(spark, sf).select(
        "device_id", "seq", S.soft_threshold(v, 25.0).alias("soft"), S.hard_threshold(v, 25.0).alias("hard"),
        S.finite(v / F.lit(1.0)).alias("is_finite")))


@query
def noise_sigma(spark: SparkSession, sf: str) -> DataFrame:
    """Sigma per day and device: the aggregate form, which holds counts of distinct values and no arrays of rows."""
    s = tables.series(spark, sf).withColumn("day", F.unix_date(F.to_date("ts")))
    return rounded(s.groupBy("device_id", "day").agg(S.noise_sigma_of(F.col("x") - 50.0).alias("sigma")))


# --- detection and publishing -----------------------------------------------------------

def _series_states(spark: SparkSession, sf: str) -> DataFrame:
    return D.detect(tables.series(spark, sf), 0.53, 2, 6 * HOUR)


def _published(spark: SparkSession, sf: str) -> DataFrame:
    return L.published(_series_states(spark, sf), HOUR, heartbeat_ms=12 * HOUR * 1000, times=tables.series(spark, sf))


@query
def default_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.default_scores(features(tables.packets(spark, sf))).select("device_id", "seq", "score"))


@query
def calibrated_score(spark: SparkSession, sf: str) -> DataFrame:
    f = materialise(features(tables.packets(spark, sf)), "features")  # read by the calibration and by the scoring
    return rounded(D.scores(f, L.calibrate(f).model).select("device_id", "seq", "score", "mode"))


@query
def motion_detections(spark: SparkSession, sf: str) -> DataFrame:
    d = L.motion_detections(tables.packets(spark, sf), 0.53, 2, 1)
    return rounded(d.select("device_id", "seq", us("ts"), "score", "state", "confidence"))


@query
def calibrated_detections(spark: SparkSession, sf: str) -> DataFrame:
    d = L.calibrated_detections(tables.packets(spark, sf), 0.53, 2, 1)
    return rounded(d.select("device_id", "seq", "score", "threshold", "state", "confidence"))


@query
def series_detections(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_series_states(spark, sf).select("device_id", "seq", "state", "confidence"))


@query
def detection_events(spark: SparkSession, sf: str) -> DataFrame:
    js = B.detection_events(_series_states(spark, sf))
    ev = js.select("device_id", F.from_json(
        "value", "movement DOUBLE, confidence DOUBLE, state STRING, timestamp BIGINT").alias("e"))
    return rounded(ev.select("device_id", "e.movement", "e.confidence", "e.state", "e.timestamp"))


@query
def tick_samples(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.ticks(_series_states(spark, sf), HOUR).select("device_id", us("ts"), "state", "score", "confidence"))


@query
def publish_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_published(spark, sf).select("device_id", us("ts"), "state", "score", "published"))


@query
def emission_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.reduction(_published(spark, sf)))


@query
def packet_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = B.packet_rate(mixed_packets(spark, sf))
    return rounded(r.withColumn("second", F.unix_seconds("second")))


@query
def movement_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.movement_alerts(_series_states(spark, sf)).select("device_id", "seq", "score", "confidence"))


@query
def inactivity_alerts(spark: SparkSession, sf: str) -> DataFrame:
    a = B.inactivity_alerts(_series_states(spark, sf))
    return rounded(a.select("device_id", us("idle_since"), us("alert_ts"), "idle_hours"))


@query
def occupancy(spark: SparkSession, sf: str) -> DataFrame:
    o = B.occupancy(_series_states(spark, sf), F.col("device_id") % 12, "6 hours")
    return rounded(o.withColumn("window_start", F.unix_micros("window_start")))


@query
def state_names(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("l_linenumber") - 1).cast("int")
    return tables.table(spark, sf, "lineitem").groupBy(
        S.decode(code, S.STATE_NAMES).alias("state"), S.decode(code, S.PHASE_NAMES).alias("phase")).agg(
        F.count(F.lit(1)).alias("n"))


# --- calibration ------------------------------------------------------------------------

def _calibration(spark: SparkSession, sf: str) -> L.Calibration:
    return L.calibrate(features(tables.packets(spark, sf)))


@query
def phase_assignment(spark: SparkSession, sf: str) -> DataFrame:
    p = C.assign_phases(tables.packets(spark, sf).drop("phase"), 60)
    return p.select("device_id", "seq", F.coalesce("phase", F.lit("")).alias("phase"),
                    F.coalesce("sample_in_phase", F.lit(0)).cast("long").alias("sample_in_phase"))


@query
def calibration_progress(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.progress(tables.packets(spark, sf), 80).fillna(0, ["eta_seconds"]))


@query
def phase_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = C.phase_events(C.assign_phases(tables.packets(spark, sf).drop("phase"), 60), 60)
    return ev.select("device_id", "seq", F.from_json("value", "type STRING, phase STRING, phase_target_samples INT").alias("e")
                     ).select("device_id", "seq", "e.type", "e.phase", "e.phase_target_samples")


@query
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_calibration(spark, sf).stats)


@query
def fisher_rank(spark: SparkSession, sf: str) -> DataFrame:
    r = C.ranked(_calibration(spark, sf).pairs).withColumn("standard_fisher", C.fisher(modified=False))
    return rounded(r.select("device_id", "feature_idx", "feature", "fisher", "standard_fisher", "rank"))


@query
def separation_approaches(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.best_approach(C.raw_separation(_calibration(spark, sf).pairs)))


@query
def calibration_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_calibration(spark, sf).model.select(
        "device_id", "rank", "feature_idx", "feature", "fisher", "weight", "feat_min", "feat_max"))


@query
def calibration_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _calibration(spark, sf).summary
    return rounded(s.withColumn("warning", F.coalesce(F.get("warnings", F.lit(0)), F.lit(""))).drop("warnings"))


@query
def calibration_status(spark: SparkSession, sf: str) -> DataFrame:
    c = _calibration(spark, sf)
    return C.status(c.stats, c.model)


@query
def calibration_status_partial(spark: SparkSession, sf: str) -> DataFrame:
    """With one device that never moved."""
    c = L.calibrate(features(tables.packets(spark, sf).where("not (device_id = 2 and phase = 'MOVEMENT')")))
    return C.status(c.stats, c.model)


@query
def filter_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.filter_advice(C.signal_quality(_calibration(spark, sf).pairs)))


@query
def model_validity(spark: SparkSession, sf: str) -> DataFrame:
    c = _calibration(spark, sf)
    return rounded(C.valid_models(c.model, c.summary))


@query
def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    c = _calibration(spark, sf)
    js = C.report(c.model, c.summary, C.filter_advice(C.signal_quality(c.pairs)))
    schema = ("type STRING, summary STRUCT<baseline_samples_collected BIGINT, separation_quality STRING, "
              "optimal_threshold DOUBLE, num_features_selected BIGINT, top_features ARRAY<STRUCT<name STRING, weight DOUBLE>>, "
              "filter_config STRUCT<butterworth BOOLEAN, wavelet BOOLEAN, wavelet_level INT, savgol BOOLEAN>>, "
              "warnings ARRAY<STRING>")
    e = js.select("device_id", F.from_json("value", schema).alias("e"))
    s = "e.summary"
    return rounded(e.select(
        "device_id", "e.type", F.col(f"{s}.baseline_samples_collected").alias("baseline_samples"),
        F.col(f"{s}.separation_quality").alias("quality"), F.col(f"{s}.optimal_threshold").alias("threshold"),
        F.col(f"{s}.num_features_selected").alias("num_selected"),
        F.col(f"{s}.top_features")[0]["name"].alias("top_1"), F.col(f"{s}.top_features")[2]["name"].alias("top_3"),
        F.size(f"{s}.top_features").alias("n_top"), F.col(f"{s}.filter_config.savgol").alias("savgol"),
        F.coalesce(F.col(f"{s}.filter_config.wavelet_level"), F.lit(0)).alias("wavelet_level"),
        F.size("e.warnings").alias("n_warnings")))


@query
def feature_report(spark: SparkSession, sf: str) -> DataFrame:
    f = features(tables.packets(spark, sf))
    return rounded(C.feature_report(M.latest(f), L.calibrate(f).model))


@query
def model_store(spark: SparkSession, sf: str) -> DataFrame:
    c = _calibration(spark, sf)
    path = workdir(spark, "model")
    stores.save_model(c.model, c.summary, path)
    return rounded(stores.load_model(spark, path).select(
        "device_id", "rank", "feature_idx", "weight", "feat_min", "feat_max", "threshold"))


# --- segmentation -----------------------------------------------------------------------

SEG = dict(window=10, shortest=5, longest=40)


def _segments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = G.turbulence(tables.packets(spark, sf))
    thr = G.adaptive_threshold(t, window=SEG["window"], k=0.5)
    return t, G.segments(t, thr, **SEG)


@query
def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.adaptive_threshold(G.turbulence(tables.packets(spark, sf)), window=10, k=2.5))


@query
def motion_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf)[1]


@query
def segment_features(spark: SparkSession, sf: str) -> DataFrame:
    t, segs = _segments(spark, sf)
    return rounded(G.segment_features(t, segs, longest=SEG["longest"]))


@query
def count_rule(spark: SparkSession, sf: str) -> DataFrame:
    t, segs = _segments(spark, sf)
    return rounded(G.count_rule(t, segs))


@query
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.grid_search(G.turbulence(tables.packets(spark, sf)), ks=(0.0, 0.5, 1.0, 1.5, 2.0),
                                 shortest=(2, 5, 10, 15), longest=(10, 20, 40)))


@query
def grid_top(spark: SparkSession, sf: str) -> DataFrame:
    g = G.grid_search(G.turbulence(tables.packets(spark, sf)))
    return rounded(G.top_configs(g).select("device_id", "rank", "combo", "false_positives", "true_positives", "score", "best"))


def _forest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame] | None:
    t, segs = _segments(spark, sf)
    return segment_forest(G.segment_features(t, segs, longest=SEG["longest"]))


@query
def segment_forest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The forest on the segments held out; no row where there are too few segments for one (``count_rule`` serves then)."""
    got = _forest(spark, sf)
    names = ("accuracy", "precision", "recall", "f1")
    if got is None:
        return spark.createDataFrame([], ", ".join(f"{n} double" for n in names) + ", n_train long, n_test long")
    return rounded(got[0].select(*names, "n_train", "n_test"))


@query
def segment_forest_importances(spark: SparkSession, sf: str) -> DataFrame:
    got = _forest(spark, sf)
    if got is None:
        return spark.createDataFrame([], "feature string, importance double")
    return rounded(got[1])


@query
def segment_split(spark: SparkSession, sf: str) -> DataFrame:
    """How many segments of each class are held out."""
    t, segs = _segments(spark, sf)
    s = split(segs)
    return s.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


# --- evaluation -------------------------------------------------------------------------

def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.packets(spark, sf)
    # Used for the ranges and for the counts.
    f = materialise(E.skip_warmup(features(p), profile=measure(p).of_subset()), "features")
    return E.wide_histogram(f, K.FEATURES)


@query
def warmup_skip(spark: SparkSession, sf: str) -> DataFrame:
    return E.skip_warmup(tables.packets(spark, sf)).select("device_id", "phase", "seq")


@query
def otsu(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.otsu(_histogram(spark, sf)).select("device_id", "feature_idx", "feature", "threshold"))


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.metrics(E.otsu(_histogram(spark, sf))).drop("threshold"))


@query
def feature_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.ranking(E.metrics(E.otsu(_histogram(spark, sf)))).select(
        "device_id", "feature_idx", "accuracy", "f1", "accuracy_rank", "f1_rank"))


@query
def best_features(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_features(E.metrics(E.otsu(_histogram(spark, sf))))


# --- spectra and subcarriers ------------------------------------------------------------

@query
def subcarrier_fisher(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.subcarrier_fisher(tables.packets(spark, sf)).where("rank <= 15"))


@query
def zone_fisher(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.zone_fisher(X.subcarrier_fisher(tables.packets(spark, sf)), (10, 25)))


@query
def best_range(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.best_range(X.subcarrier_fisher(tables.packets(spark, sf)), (6, 10, 15, 20, 30)))


@query
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.covariance(tables.packets(spark, sf)))


@query
def covariance_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Over packets of three lengths."""
    return rounded(X.pair_covariance(mixed_packets(spark, sf)))


@query
def pca(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.pca(X.covariance(tables.packets(spark, sf))).drop("loadings"))


@query
def pca_loadings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.top_loadings(X.pca(X.covariance(tables.packets(spark, sf)))))


def _doppler(spark: SparkSession, sf: str) -> DataFrame:
    f = Q.feature_struct(F.col("iq").cast("array<int>"), ["mean_amplitude"])
    amp = tables.packets(spark, sf).select("device_id", "phase", "ts", "seq", f["mean_amplitude"].alias("amp"))
    return X.doppler_features(X.doppler_frames(amp, "amp"))


@query
def doppler_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_doppler(spark, sf))


@query
def doppler_ranking(spark: SparkSession, sf: str) -> DataFrame:
    long = long_form(_doppler(spark, sf), ("device_id", "phase"), K.DOPPLER_FEATURES)
    return rounded(E.ranking(E.metrics(E.otsu(E.histogram(long)))).select(
        "device_id", "feature", "tp", "tn", "fp", "fn", "accuracy", "f1", "accuracy_rank"))


# --- control and stores -----------------------------------------------------------------

@query
def capture_log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = workdir(spark, "capture")
    capture_log.write(tables.packets(spark, sf), path)
    back = capture_log.read(spark, path)
    return back.groupBy("phase", F.size("iq").alias("n_values")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(P.total(F.col("iq"))).alias("total"),
        F.sum(P.total_sq(F.col("iq"))).alias("total_sq"))


@query
def capture_lines(spark: SparkSession, sf: str) -> DataFrame:
    return capture_log.render(tables.packets(spark, sf))


@query
def commands_validated(spark: SparkSession, sf: str) -> DataFrame:
    v = M.validate(tables.commands(spark, sf))
    return rounded(v.select("device_id", "seq", F.coalesce("cmd", F.lit("")).alias("cmd"),
                            F.coalesce("kind", F.lit("")).alias("kind"), "accepted", "setting",
                            F.coalesce("error", F.lit("")).alias("error")))


@query
def command_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Errors, and what each accepted setting changed from which value to which."""
    a = N.answers(M.validate(tables.commands(spark, sf)))
    return a.select("device_id", "seq", B.response(F.col("answer")).alias("response"))


@query
def calibration_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every ``calibrate`` command with its answer; of a status question the answer is one document."""
    p, messages = tables.packets(spark, sf), M.validate(tables.calibration_commands(spark, sf))
    refused = messages.where(~F.col("accepted")).select("device_id", "seq", "action", F.lit(0).cast("long").alias("session"), F.lit(False).alias("taken"), F.lit("").alias("phase"), F.col("error").alias("response"))
    return N.calls(p, messages).select("device_id", "seq", "action", "session", "taken", "phase", "response").unionByName(refused)


@query
def calibrate_status(spark: SparkSession, sf: str) -> DataFrame:
    """The status of every device once all its packets and commands are through."""
    p = tables.packets(spark, sf)
    last = p.groupBy("device_id").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    ask = last.select("device_id", "seq", (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.lit('{"cmd":"calibrate","action":"status"}').alias("message"))
    asked = N.calls(p, M.validate(tables.calibration_commands(spark, sf).unionByName(ask)))
    doc = F.from_json("response", "phase STRING, active BOOLEAN, samples_collected LONG, samples_target LONG, estimated_time_remaining_sec LONG").alias("d")
    ends = asked.join(ask.select("device_id", "ts"), ["device_id", "ts"], "left_semi")
    return ends.select("device_id", "session", doc).select("device_id", "session", "d.*")


@query
def calibration_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The packets that the sessions between ``calibrate`` commands took."""
    s = N.sessions(tables.packets(spark, sf), M.validate(tables.calibration_commands(spark, sf)))
    return s.select("device_id", "seq", "session", "phase", "sample_in_phase")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.commands(spark, sf)
    return M.config_history(M.validate(log), profile=measure(log))


@query
def config_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_history(spark, sf).select(
        "device_id", "seq", us("valid_from"), F.coalesce(F.unix_micros("valid_to"), F.lit(-1)).alias("valid_to"), "threshold", "debounce_count", "persistence_timeout",
        "hysteresis_ratio", "csi_logs_enabled", "threshold_low", "packet_rate"))


@query
def config_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.series(spark, sf).select("device_id", "ts", "seq", "score")
    log = tables.commands(spark, sf)
    prof = measure(rows.select("device_id", "ts", "seq").unionByName(log.select("device_id", "ts", "seq")))
    out = M.as_of(rows, M.config_history(M.validate(log), profile=prof), profile=prof)
    return rounded(out.drop("ts").withColumn("above", F.col("score") > F.col("threshold")))


def _stored_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Stored records with faults: derived from the events, whose values run past every limit."""
    v, n = F.col("value"), F.col("event_id")
    return tables.table(spark, sf, "events").select(
        F.col("event_id").alias("device_id"), F.when(n % 9 == 4, 2).otherwise(1).alias("version"),
        (v / 100).alias("threshold"), (n % 13).cast("double").alias("debounce_count"), (v / 90).alias("hysteresis_ratio"),
        (n % 35).cast("double").alias("persistence_timeout"), F.when(n % 50 == 7, F.lit(float("nan"))).otherwise(v / 9).alias("hampel_threshold"),
        (n % 14).cast("double").alias("savgol_window_size"), (n % 5).cast("double").alias("wavelet_level"),
        (v / 40).alias("wavelet_threshold"))


@query
def config_repair(spark: SparkSession, sf: str) -> DataFrame:
    r = M.repair(_stored_configs(spark, sf))
    return rounded(r.withColumn("repaired", F.concat_ws(",", "repaired")))


@query
def config_checks(spark: SparkSession, sf: str) -> DataFrame:
    return M.runtime_checks(_stored_configs(spark, sf)).select(
        "device_id", "debounce_ok", "hysteresis_ok", "persistence_ok", "valid")


@query
def config_store(spark: SparkSession, sf: str) -> DataFrame:
    path = workdir(spark, "config")
    stores.save_config(_stored_configs(spark, sf), path)
    return rounded(stores.load_config(spark, path).select("device_id", "threshold", "hampel_threshold", "savgol_window_size"))


@query
def status_reports(spark: SparkSession, sf: str) -> DataFrame:
    r = M.stats_report(tables.series(spark, sf), _history(spark, sf))
    return rounded(r.withColumn("error", F.coalesce("error", F.lit(""))))


@query
def info_reports(spark: SparkSession, sf: str) -> DataFrame:
    j = M.info_report(_history(spark, sf), tables.commands(spark, sf))
    schema = ("detection STRUCT<threshold DOUBLE, debounce INT, persistence_timeout INT, hysteresis_ratio DOUBLE>, "
              "traffic_generator_rate INT, filters STRUCT<hampel_enabled BOOLEAN, wavelet_level INT>, "
              "features STRUCT<csi_logs_enabled BOOLEAN>")
    e = j.select("device_id", F.from_json("value", schema).alias("e"))
    return rounded(e.select("device_id", "e.detection.*", "e.traffic_generator_rate", "e.filters.*", "e.features.*"))


@query
def normaliser_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.latest(R.ewma(tables.series(spark, sf), "x")).select(
        "device_id", F.col("ewma_mean").alias("current_mean"), F.col("ewma_variance").alias("current_variance"),
        F.col("ewma_stddev").alias("current_stddev")))


# --- streams ----------------------------------------------------------------------------

PACKET_LATENESS, SERIES_LATENESS = "10 seconds", "6 hours"
"""Tolerances of the streams; the tables are replayed in time order, packets by the second, the series by the hour."""


def _packet_stream(spark: SparkSession, sf: str, name: str, delayed: F.Column | None = None) -> DataFrame:
    return J.replay(tables.packets(spark, sf), name, PACKET_LATENESS, delayed=delayed)


def _hourly(rows: DataFrame, name: str) -> DataFrame:
    # Four triggers, each of as many files as tasks can read side by side.
    n = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    return J.replay(rows, name, SERIES_LATENESS, HOUR * 1000, files=4 * n, files_per_trigger=n)


@query
def stream_detections(spark: SparkSession, sf: str) -> DataFrame:
    out = J.run_to_table(spark, J.detections(_packet_stream(spark, sf, "detections"), 0.53, 2, 1, lateness=PACKET_LATENESS), "stream_detections")
    return rounded(out.select("device_id", "seq", us("ts"), "score", "state", "confidence"))


@query
def stream_publish(spark: SparkSession, sf: str) -> DataFrame:
    out = J.run_to_table(spark, J.detections(_packet_stream(spark, sf, "publish"), 0.53, 2, 1, heartbeat_ms=500, lateness=PACKET_LATENESS), "stream_publish")
    return out.select("device_id", "seq", "state", "published")


@query
def stream_series_detections(spark: SparkSession, sf: str) -> DataFrame:
    states = J.debounced(_hourly(tables.series(spark, sf), "series"), 0.53, 2, 6 * HOUR, lateness=SERIES_LATENESS, bucket_ms=HOUR * 1000)
    return J.run_to_table(spark, states, "stream_series").select("device_id", "seq", "state")


@query
def stream_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """The latest values every hour, to the first hour after the table; up to a device's last row they are those of ``tick_samples``."""
    out = J.run_to_table(spark, J.ticks(_hourly(_series_states(spark, sf), "ticks"), HOUR, SERIES_LATENESS, HOUR * 1000), "stream_ticks")
    return rounded(out.select("device_id", us("ts"), "state", "score", "confidence"))


@query
def stream_idle_resets(spark: SparkSession, sf: str) -> DataFrame:
    """The resets behind the epochs of ``ewma_reset``, and those after a device's last row."""
    out = J.run_to_table(spark, J.idle_resets(_hourly(_series_states(spark, sf), "resets"), 24 * HOUR, HOUR, SERIES_LATENESS, HOUR * 1000), "stream_resets")
    return out.select("device_id", us("reset_ts"), "resets")


@query
def stream_inactivity_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts at the moment they are due, also for devices that fell silent."""
    out = J.run_to_table(spark, J.inactivity_alerts(_hourly(_series_states(spark, sf), "alerts"), lateness=SERIES_LATENESS, bucket_ms=HOUR * 1000), "stream_alerts")
    return out.select("device_id", us("idle_since"), us("alert_ts"))


def _phases(spark: SparkSession, sf: str) -> DataFrame:
    return J.run_to_table(spark, J.phases(_packet_stream(spark, sf, "phases"), 60, PACKET_LATENESS), "stream_phases")


@query
def stream_phases(spark: SparkSession, sf: str) -> DataFrame:
    return _phases(spark, sf).select("device_id", "seq", F.coalesce("phase", F.lit("")).alias("phase"), F.coalesce("sample_in_phase", F.lit(0)).cast("long").alias("sample_in_phase"))


@query
def stream_phase_events(spark: SparkSession, sf: str) -> DataFrame:
    begins = _phases(spark, sf).where("begins").withColumn("phase", F.coalesce("phase", F.lit("ANALYZING")))
    return C.phase_notices(begins, 60).select("device_id", "seq", F.from_json("value", "type STRING, phase STRING, phase_target_samples INT").alias("e")
                                              ).select("device_id", "seq", "e.type", "e.phase", "e.phase_target_samples")


@query
def stream_config_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The configuration in force for every row, with rows and command messages both as streams."""
    rows = tables.series(spark, sf).select("device_id", "ts", "seq", "score")
    out = J.run_to_table(spark, J.config_as_of(_hourly(rows, "rows"), _hourly(tables.commands(spark, sf), "messages"), lateness=SERIES_LATENESS, bucket_ms=HOUR * 1000), "stream_config")
    return rounded(out.drop("ts").withColumn("above", F.col("score") > F.col("threshold")))


@query
def stream_packet_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = J.run_to_table(spark, J.packet_rate(_packet_stream(spark, sf, "rate"), PACKET_LATENESS), "stream_rate")
    return out.select("device_id", F.unix_seconds("second").alias("second"), "received")


@query
def stream_capture(spark: SparkSession, sf: str) -> DataFrame:
    return J.run_to_table(spark, J.capture(tables.packets_from(J.stream_table(spark, sf, "embeddings"))), "stream_capture", "text")


@query
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of every device with one in 47 held back until all others are through: those of seconds that were given are late and left out."""
    packets = tables.packets(spark, sf)
    stream = J.detections(_packet_stream(spark, sf, "late", F.col("seq") % 47 == 7), 0.53, 2, 1, lateness=PACKET_LATENESS)
    both = packets.select("device_id", F.lit(1).alias("received"), F.lit(0).alias("given")).unionByName(
        J.run_to_table(spark, stream, "stream_late").select("device_id", F.lit(0).alias("received"), F.lit(1).alias("given")))
    return both.groupBy("device_id").agg(F.sum("received").alias("received"), (F.sum("received") - F.sum("given")).alias("late"))
