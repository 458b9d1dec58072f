"""Supervised calibration: phase statistics -> ranking -> model, threshold and filter advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import scalar as S
from rfsense.operators.features import long_form
from rfsense.operators.layout import arrange

PHASES = ("BASELINE", "MOVEMENT")


def assign_phases(packets: DataFrame, samples: int, piece_rows: int | None = None) -> DataFrame:
    """First ``samples`` rows of a device BASELINE, the next ``samples`` MOVEMENT, the rest none."""
    if not 50 <= samples <= 10000:
        raise ValueError("samples must be within 50..10000")
    lay = arrange(packets, piece_rows=piece_rows)
    n = F.col("_n")
    return lay.done(
        lay.df.withColumn("_n", lay.pos() + 1)
        .withColumn("phase", F.when(n <= samples, "BASELINE").when(n <= 2 * samples, "MOVEMENT"))
        .withColumn("sample_in_phase", F.when(n <= 2 * samples, (n - 1) % samples + 1))
    ).drop("_n")


def progress(phased: DataFrame, samples: int, rate: int = 20) -> DataFrame:
    """Calibration progress, remaining samples and seconds per device after its rows so far."""
    n = F.col("rows")
    done = (
        phased.groupBy("device_id").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("phase", F.when(n >= 2 * samples, "ANALYZING").when(n >= samples, "MOVEMENT")
                    .otherwise("BASELINE"))
        .withColumn("samples_collected", F.when(F.col("phase") == "ANALYZING", samples)
                    .when(F.col("phase") == "MOVEMENT", n - samples).otherwise(n).cast("long"))
    )
    frac = F.col("samples_collected") / F.lit(float(samples))
    left = F.lit(samples) - F.col("samples_collected")
    return done.select(
        "device_id", "phase", "samples_collected",
        F.when(F.col("phase") == "ANALYZING", 1.0).when(F.col("phase") == "MOVEMENT", 0.5 + 0.5 * frac)
        .otherwise(0.5 * frac).alias("progress"),
        left.cast("long").alias("samples_remaining"),
        F.when((left > 0) & F.lit(rate > 0), F.floor(left / F.lit(max(rate, 1)))).alias("eta_seconds"))


def phase_events(phased: DataFrame, samples: int, piece_rows: int | None = None) -> DataFrame:
    """One status event per phase change of a device."""
    from rfsense.operators.publish import state_changes

    df = phased.withColumn("phase", F.coalesce(F.col("phase"), F.lit("ANALYZING")))
    return phase_notices(state_changes(df.select("device_id", "ts", "seq", "phase"), "phase", piece_rows), samples)


def phase_notices(begins: DataFrame, samples: int) -> DataFrame:
    """The status event of each row that begins a phase."""
    target = F.when(F.col("phase") == "ANALYZING", 0).otherwise(samples)
    return begins.select("device_id", "seq", "phase", F.to_json(F.struct(
        F.lit("calibration_status").alias("type"), "phase", target.alias("phase_target_samples"))).alias("value"))


def feature_stats(feats: DataFrame) -> DataFrame:
    """Count, mean, sample variance and range per device, phase and feature."""
    rows = long_form(feats.where(F.col("phase").isin(*PHASES)), ("device_id", "phase"))
    return rows.groupBy("device_id", "phase", "feature_idx", "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def paired(stats: DataFrame) -> DataFrame:
    """Baseline (b_) and movement (m_) statistics of a feature side by side."""
    cols = []
    for phase, p in zip(PHASES, "bm", strict=True):
        cols += [F.max(F.when(F.col("phase") == phase, F.col(c))).alias(f"{p}_{c}")
                 for c in ("n", "mean", "var", "min", "max")]
    return stats.groupBy("device_id", "feature_idx", "feature").agg(*cols).where(
        F.col("b_n").isNotNull() & F.col("m_n").isNotNull())


def fisher(modified: bool = True) -> Column:
    """Class separation on the common [0, 1] scale of both phases."""
    rng = F.greatest("b_max", "m_max") - F.least("b_min", "m_min")
    d = F.abs(F.col("m_mean") - F.col("b_mean")) / rng
    v = (F.col("b_var") + F.col("m_var")) / (rng * rng)
    score = d * d / (F.sqrt(v) if modified else v)
    few = (F.col("b_n") < 2) | (F.col("m_n") < 2)
    return F.when(few | (rng < K.EPS), 0.0).otherwise(F.when(v < K.EPS, 0.0).otherwise(score))


def raw_separation(pairs: DataFrame) -> DataFrame:
    """Raw-scale Fisher, modified Fisher and mean ratio per feature."""
    d, v = F.col("m_mean") - F.col("b_mean"), F.col("b_var") + F.col("m_var")
    b, m = F.abs("b_mean") + K.EPS, F.abs("m_mean") + K.EPS
    ok = v > K.EPS
    return pairs.select(
        "device_id", "feature_idx", "feature", "b_mean", "m_mean",
        F.when(ok, d * d / v).otherwise(0.0).alias("fisher"),
        F.when(ok, d * d / F.sqrt(v)).otherwise(0.0).alias("modified_fisher"),
        (F.greatest(b, m) / F.least(b, m)).alias("mean_ratio"))


def best_approach(sep: DataFrame) -> DataFrame:
    """Best feature by each criterion, their separations, and the criterion that separates most."""

    def top(metric: str) -> Column:
        return F.max_by(F.struct("feature", "b_mean", "m_mean", metric),
                        F.struct(F.col(metric), -F.col("feature_idx")))

    best = sep.groupBy("device_id").agg(
        top("fisher").alias("f"), top("modified_fisher").alias("g"), top("mean_ratio").alias("r"))

    def ratio(s: str) -> Column:
        return F.col(f"{s}.m_mean") / (F.col(f"{s}.b_mean") + K.EPS)

    out = best.select("device_id", F.col("f.feature").alias("fisher_feature"), ratio("f").alias("fisher_separation"),
                      F.col("g.feature").alias("modified_feature"), ratio("g").alias("modified_separation"),
                      F.col("r.feature").alias("ratio_feature"), F.col("r.mean_ratio").alias("ratio_separation"))
    most = F.greatest("fisher_separation", "modified_separation", "ratio_separation")
    return out.withColumn("winner", F.when(F.col("fisher_separation") == most, "fisher")
                          .when(F.col("modified_separation") == most, "modified_fisher").otherwise("mean_ratio"))


def ranked(pairs: DataFrame) -> DataFrame:
    """All features of a device by separation, ties by index."""
    w = Window.partitionBy("device_id").orderBy(F.desc("fisher"), "feature_idx")
    return pairs.withColumn("fisher", fisher()).withColumn("rank", F.row_number().over(w))


def model(pairs: DataFrame) -> DataFrame:
    """Selected features with weights and ranges, for devices with enough samples and any separation."""
    dev = Window.partitionBy("device_id")
    r = ranked(pairs).withColumn("_best", F.max("fisher").over(dev))
    enough = (F.col("b_n") >= K.MIN_CALIBRATION_ROWS) & (F.col("m_n") >= K.MIN_CALIBRATION_ROWS)
    picked = r.where(enough & (F.col("_best") > 0)).where(
        (F.col("rank") <= K.MIN_SELECTED)
        | ((F.col("rank") <= K.MAX_SELECTED) & (F.col("fisher") >= K.FISHER_MIN_RATIO * F.col("_best"))))
    lo, hi = F.least("b_min", "m_min"), F.greatest("b_max", "m_max")
    rng = hi - lo
    total = F.sum("fisher").over(dev)
    return picked.select(
        "device_id", "rank", "feature_idx", "feature", "fisher",
        F.when(total > K.EPS, F.col("fisher") / total).otherwise(1.0 / F.count(F.lit(1)).over(dev)).alias("weight"),
        F.when(rng > K.EPS, lo - rng * 0.1).otherwise((lo + hi) / 2 - 0.05).alias("feat_min"),
        F.when(rng > K.EPS, hi + rng * 0.1).otherwise((lo + hi) / 2 + 0.05).alias("feat_max"),
        "b_n", "m_n", "b_mean", "m_mean", "b_var", "m_var")


def threshold(b: Column, m: Column, sb: Column, sm: Column, ratio: Column) -> Column:
    """Variance-weighted point between the phase scores, with its margin and bounds in their order."""
    v = sb + sm
    mid = (b + m) / 2
    t = F.when(v >= K.EPS, (sm * b + sb * m) / v).otherwise(mid)
    t = F.when(S.finite(t), t).when(S.finite(mid), mid).otherwise(0.5)
    margin = F.greatest(F.lit(1.0), F.least(1.0 + (ratio - 1.0) * 0.5, F.lit(K.SAFETY_MARGIN)))
    t = t * F.when((ratio < 2.0) & S.finite(ratio), margin).otherwise(K.SAFETY_MARGIN)
    t = F.greatest(t, b + (m - b) * 0.3)
    t = F.least(t, b + (m - b) * 0.7)
    return F.least(F.greatest(t, F.lit(K.THRESHOLD_MIN)), F.lit(K.THRESHOLD_MAX))


def summary(mdl: DataFrame, normalised: bool = False) -> DataFrame:
    """Scores of both phases, separation and threshold per device."""
    w, rng = F.col("weight"), F.col("feat_max") - F.col("feat_min")
    scale = rng * rng if normalised else F.lit(1.0)
    agg = mdl.groupBy("device_id").agg(
        F.max("b_n").alias("baseline_samples"), F.max("m_n").alias("movement_samples"),
        F.sum(w * S.normalise(F.col("b_mean"), F.col("feat_min"), F.col("feat_max"))).alias("baseline_score"),
        F.sum(w * S.normalise(F.col("m_mean"), F.col("feat_min"), F.col("feat_max"))).alias("movement_score"),
        F.sum(F.col("b_var") / scale * w * w).alias("_sb"), F.sum(F.col("m_var") / scale * w * w).alias("_sm"),
        F.count(F.lit(1)).alias("num_selected"))
    b, m = F.col("baseline_score"), F.col("movement_score")
    agg = agg.withColumn("separation_ratio", F.when(b > K.EPS, m / b).otherwise(0.0))
    ratio = F.col("separation_ratio")
    return agg.select(
        "device_id", "baseline_samples", "movement_samples", "baseline_score", "movement_score",
        "separation_ratio", S.separation_quality(ratio).alias("quality"), "num_selected",
        threshold(b, m, F.col("_sb"), F.col("_sm"), ratio).alias("threshold"),
        (m < b).alias("inverted"), S.separation_warnings(ratio).alias("warnings"))


def status(stats: DataFrame, mdl: DataFrame) -> DataFrame:
    """DONE for devices with a model; FAILED with the reason for all others that have rows of either phase."""
    def samples(phase: str) -> Column:
        return F.coalesce(F.min(F.when(F.col("phase") == phase, F.col("n"))), F.lit(0))

    counts = stats.groupBy("device_id").agg(
        samples("BASELINE").alias("baseline_samples"), samples("MOVEMENT").alias("movement_samples"))
    done = mdl.select("device_id").distinct().withColumn("_ok", F.lit(True))
    few = ((F.col("baseline_samples") < K.MIN_CALIBRATION_ROWS)
           | (F.col("movement_samples") < K.MIN_CALIBRATION_ROWS))
    ok = F.col("_ok").isNotNull()
    return counts.join(done, "device_id", "left").select(
        "device_id", "baseline_samples", "movement_samples",
        F.when(ok, "DONE").otherwise("FAILED").alias("status"),
        F.when(ok, "").when(few, "insufficient samples").otherwise("no separation").alias("reason"))


def signal_quality(pairs: DataFrame) -> DataFrame:
    """Outlier ratio, mean signal-to-noise ratio and baseline drift per device."""
    two = F.col("b_n") >= 2
    mu, var = F.col("b_mean"), F.col("b_var")
    std = F.sqrt(var)
    snr = F.when(two & (F.col("m_n") >= 2) & (std > K.EPS), F.abs(F.col("m_mean") - mu) / std)
    return pairs.groupBy("device_id").agg(
        (F.count_if(two & (mu > 0.01) & (var > 4.0 * mu * mu)) / len(K.FEATURES)).alias("outlier_ratio"),
        F.coalesce(F.avg(snr), F.lit(0.0)).alias("snr"),
        F.coalesce(F.avg(F.when(two & (mu > K.EPS), std / mu)), F.lit(0.0)).alias("drift"),
        F.max(F.when(F.col("feature_idx") == 0, mu)).alias("baseline_variance"))


def filter_advice(quality: DataFrame) -> DataFrame:
    """Which filters to switch on, and their parameters."""
    o, v, d = F.col("outlier_ratio"), F.col("baseline_variance"), F.col("drift")
    return quality.select(
        "device_id", "outlier_ratio", "snr", "drift", "baseline_variance",
        F.lit(True).alias("butterworth"),
        (o > 0.05).alias("hampel"),
        F.when(o > 0.15, 3.0).when(o > 0.05, 2.0).alias("hampel_threshold"),
        (F.col("snr") < 10.0).alias("savgol"),
        (v > 500.0).alias("wavelet"), F.lit(3).alias("wavelet_level"),
        F.when(v > 800.0, 2.0).when(v > 600.0, 1.5).otherwise(1.0).alias("wavelet_threshold"),
        (d > 0.1).alias("adaptive_normalizer"),
        F.when(d > 0.3, 0.02).when(d > 0.1, 0.01).alias("adaptive_normalizer_alpha"))


def report(mdl: DataFrame, summ: DataFrame, advice: DataFrame) -> DataFrame:
    """Calibration report as one JSON document per device; unset keys are left out."""
    top = mdl.where(F.col("rank") <= 3).groupBy("device_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("feature").alias("name"), "weight"))),
                    lambda s: F.struct(s["name"].alias("name"), s["weight"].alias("weight"))).alias("top_features"))
    on_w, on_h, on_n = F.col("wavelet"), F.col("hampel"), F.col("adaptive_normalizer")
    filters = F.struct(
        "butterworth", "wavelet", F.when(on_w, F.col("wavelet_level")).alias("wavelet_level"),
        F.when(on_w, F.col("wavelet_threshold")).alias("wavelet_threshold"),
        "hampel", F.when(on_h, F.col("hampel_threshold")).alias("hampel_threshold"), "savgol",
        "adaptive_normalizer", F.when(on_n, F.col("adaptive_normalizer_alpha")).alias("adaptive_normalizer_alpha"))
    joined = summ.join(top, "device_id").join(advice, "device_id")
    return joined.select("device_id", F.to_json(F.struct(
        F.lit("calibration_complete").alias("type"),
        F.struct(
            F.col("baseline_samples").alias("baseline_samples_collected"),
            F.col("movement_samples").alias("movement_samples_collected"),
            "baseline_score", "movement_score", "separation_ratio", F.col("quality").alias("separation_quality"),
            F.col("threshold").alias("optimal_threshold"), F.col("num_selected").alias("num_features_selected"),
            "top_features", filters.alias("filter_config")).alias("summary"),
        "warnings")).alias("value"))


def valid_models(mdl: DataFrame, summ: DataFrame, version: int = 1, expected_version: int = 1) -> DataFrame:
    """Per device whether the stored model passes the storage gate and the stricter apply gate."""
    w = F.col("weight")
    checks = mdl.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("feature_idx").alias("n_distinct"),
        F.bool_and((F.col("feature_idx") >= 0) & (F.col("feature_idx") < len(K.FEATURES))).alias("idx_ok"),
        F.bool_and(S.finite(w) & w.between(0.0, 1.0)).alias("w_ok"), F.sum("weight").alias("weight_sum"))
    t = F.col("threshold")
    body = (F.col("n").between(1, K.MAX_SELECTED) & (F.col("n") == F.col("n_distinct")) & F.col("idx_ok")
            & F.col("w_ok") & F.col("weight_sum").between(0.8, 1.2) & F.lit(version == expected_version))
    return checks.join(summ.select("device_id", "threshold"), "device_id").select(
        "device_id", "n", "weight_sum", t.alias("threshold"),
        (body & S.finite(t) & (t > 0) & (t < 1)).alias("valid_stored"),
        (body & S.finite(t) & t.between(0.05, 0.95)).alias("valid_applied"))


def feature_report(latest: DataFrame, mdl: DataFrame) -> DataFrame:
    """Every feature's current value with its weight in force: the model's, or for devices without a
    model the positive default. Other features show no weight."""
    rows = long_form(latest, ("device_id",))
    weights = F.create_map(*[F.lit(v) for i, wt in enumerate(K.DEFAULT_WEIGHTS) for v in (i, wt)])
    default = F.element_at(weights, F.col("feature_idx"))
    has = mdl.select("device_id").distinct().withColumn("_has", F.lit(True))
    joined = (
        rows.join(mdl.select("device_id", "feature_idx", "weight"), ["device_id", "feature_idx"], "left")
        .join(has, "device_id", "left")
    )
    shown = F.when(F.col("weight").isNotNull(), F.col("weight")).when(
        F.col("_has").isNull() & (default > 0), default)
    return joined.select("device_id", "feature_idx", "feature", "value", shown.isNotNull().alias("selected"),
                         shown.alias("weight"))
