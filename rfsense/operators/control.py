"""Control messages as data: parse, validate, fold into a configuration history, join as of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.functions import scalar as S
from rfsense.operators import windows as W
from rfsense.operators.layout import Profile, arrange

MESSAGE = "cmd STRING, value DOUBLE, enabled BOOLEAN, action STRING, samples INT, verbose BOOLEAN"

# Error texts per command.
RANGE_ERRORS = {
    "threshold": "ERROR: Threshold must be between 0.15 and 0.80",
    "persistence": "ERROR: Persistence timeout must be between 1 and 30 seconds",
    "debounce": "ERROR: Debounce count must be between 1 and 10",
    "hysteresis": "ERROR: Hysteresis ratio must be between 0.1 and 1.0",
    "hampel_threshold": "ERROR: Hampel threshold must be between 1.0 and 10.0",
    "wavelet_level": "ERROR: Wavelet level must be between 1 and 3 (recommended: 3)",
    "wavelet_threshold": "ERROR: Wavelet threshold must be between 0.5 and 2.0 (recommended: 1.0)",
    "adaptive_normalizer_alpha": "ERROR: Alpha must be between 0.001 and 0.1",
    "adaptive_normalizer_reset_timeout": "ERROR: Reset timeout must be between 0 and 300 seconds (0 = disabled)",
    "traffic_generator_rate": "ERROR: Rate must be 0-50 packets/sec (0=disabled, recommended: 15)",
}
CONFIG_COLUMNS = tuple(col for col, _ in K.CONFIG_DEFAULTS.values())


def command_spec(spark: SparkSession) -> DataFrame:
    """Known commands: name, kind, range, error text."""
    rows = [(n, k, lo, hi, RANGE_ERRORS.get(n)) for n, k, lo, hi in K.COMMANDS]
    return spark.createDataFrame(rows, "cmd string, kind string, lo double, hi double, range_error string")


def validate(messages: DataFrame, message: str = "message") -> DataFrame:
    """Parsed command, accepted flag, numeric setting and error text of every message."""
    spec = F.broadcast(command_spec(messages.sparkSession))  # two dozen fixed rows
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = messages.withColumn("_m", F.from_json(message, MESSAGE + ", _corrupt STRING", options)).select(
        *messages.columns, "_m._corrupt", F.col("_m.cmd").alias("cmd"), F.col("_m.value").alias("_value"),
        F.col("_m.enabled").alias("_enabled"), F.col("_m.action").alias("action"), F.col("_m.samples").alias("samples"), F.col("_m.verbose").alias("verbose"))
    # A field of the wrong type also counts as corrupt; only those rows are parsed again.
    malformed = F.col("_corrupt").isNotNull() & F.try_parse_json(message).isNull()
    df = parsed.join(spec, "cmd", "left")
    kind, value = F.col("kind"), F.col("_value")
    # Whole-number settings drop the fraction before the range test.
    number = F.when(kind == "int", F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")).otherwise(value)
    numeric = kind.isin("int", "float")
    # The other error texts.
    error = (
        F.when(F.col(message).isNull() | malformed, "ERROR: Invalid JSON")
        .when(F.col("cmd").isNull(), "ERROR: Missing 'cmd' field")
        .when(kind.isNull(), F.concat(F.lit("ERROR: Unknown command '"), F.col("cmd"), F.lit("'")))
        .when(numeric & value.isNull(), "ERROR: Missing or invalid 'value' field")
        .when(numeric & ~S.finite(value), "ERROR: Invalid value (NaN or Infinity)")
        .when(numeric & ~number.between(F.col("lo"), F.col("hi")), F.col("range_error"))
        .when((kind == "bool") & F.col("_enabled").isNull(), "ERROR: Missing or invalid 'enabled' field")
        .when((kind == "action") & F.col("action").isNull(), "ERROR: Missing or invalid 'action' field")
        .when((kind == "action") & ~F.col("action").isin("start", "stop", "status"),
              F.concat(F.lit("ERROR: Unknown calibration action '"), F.col("action"),
                       F.lit("' (use: start, stop, status)")))
    )
    setting = F.when(numeric, number).when(kind == "bool", F.col("_enabled").cast("double"))
    return df.withColumn("error", error).select(
        *messages.columns, "cmd", "kind", "action", "samples", "verbose", F.col("error").isNull().alias("accepted"),
        F.when(F.col("error").isNull(), setting).alias("setting"), "error")


def config_history(validated: DataFrame, piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """One configuration per accepted setting or reset, valid until the next one of the device.

    Last writer wins per column; a factory reset writes every default. ``profile`` may be that of
    the message log the commands come from.
    """
    sets = validated.where(F.col("accepted") & (F.col("setting").isNotNull() | (F.col("kind") == "reset"))
                           & F.col("cmd").isin(*K.CONFIG_DEFAULTS, "factory_reset"))
    lay = arrange(sets.select("device_id", "ts", "seq", "cmd", "setting"), after=1, piece_rows=piece_rows,
                  profile=profile and profile.of_subset())
    reset = F.col("cmd") == "factory_reset"
    writes = {col: F.when(reset, F.lit(default)).when(F.col("cmd") == cmd, F.col("setting"))
              for cmd, (col, default) in K.CONFIG_DEFAULTS.items()}
    df = lay.carry(lay.df, writes)
    df = df.withColumn("valid_to", F.lead("ts").over(lay.ordered()))
    cols = [F.coalesce(F.col(col), F.lit(default)).alias(col) for col, default in K.CONFIG_DEFAULTS.values()]
    return lay.done(df).select("device_id", "seq", F.col("ts").alias("valid_from"), "valid_to", *cols) \
        .withColumn("threshold_low", F.col("threshold") * F.col("hysteresis_ratio"))


def as_of(rows: DataFrame, history: DataFrame, cols: tuple[str, ...] = ("threshold", "debounce_count", "persistence_timeout"),
          piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """Configuration in force at the time of every row; the defaults before a device's first command.

    ``profile`` may be that of the rows together with the whole message log.
    """
    defaults = dict(K.CONFIG_DEFAULTS.values())
    keep = [c for c in rows.columns if c not in ("device_id", "ts", "seq")]
    cfg = F.struct(*[F.col(c) for c in cols])
    types = dict(rows.dtypes)
    both = rows.select("device_id", "ts", F.lit(1).alias("_kind"), "seq", *keep, F.lit(None).cast(
        "struct<" + ",".join(f"{c}:double" for c in cols) + ">").alias("_cfg")).unionByName(
        history.select("device_id", F.col("valid_from").alias("ts"), F.lit(0).alias("_kind"), "seq",
                       *[F.lit(None).cast(types[c]).alias(c) for c in keep], cfg.alias("_cfg")))
    lay = arrange(both, order=("ts", "_kind", "seq"), piece_rows=piece_rows, profile=profile and profile.of_subset())
    df = lay.done(lay.carry(lay.df, {"_now": F.col("_cfg")})).where(F.col("_kind") == 1)
    return df.select("device_id", "ts", "seq", *keep, *[
        F.coalesce(F.col(f"_now.{c}"), F.lit(defaults[c])).alias(c) for c in cols])


def repair(configs: DataFrame, version: int = 1) -> DataFrame:
    """Stored configurations with each bad field set to its default, listed in ``repaired``.

    Records of another version are marked unusable.
    """
    def num(c: str, lo: float, hi: float, open_ends: bool = False) -> Column:
        x = F.col(c)
        inside = ((x > lo) & (x < hi)) if open_ends else x.between(lo, hi)
        return S.finite(x) & inside

    size = F.col("savgol_window_size")
    # Column, test, repair value.
    rules = (
        ("threshold", num("threshold", 0.0, 1.0, True), 0.43),
        ("debounce_count", num("debounce_count", 1, 10), 3.0),
        ("hysteresis_ratio", num("hysteresis_ratio", 0.1, 1.0), 0.7),
        ("persistence_timeout", num("persistence_timeout", 1, 30), 3.0),
        ("hampel_threshold", num("hampel_threshold", 1.0, 10.0), 2.0),
        ("savgol_window_size", size.between(3, 11) & (size % 2 == 1), 5.0),
        ("wavelet_level", num("wavelet_level", 1, 3), 3.0),
        ("wavelet_threshold", num("wavelet_threshold", 0.5, 2.0), 1.0),
    )
    names = {c for c, _, _ in rules}
    others = [c for c in configs.columns if c not in names]
    good = {c: F.coalesce(ok, F.lit(False)) for c, ok, _ in rules}
    bad = F.array_compact(F.array(*[F.when(~good[c], F.lit(c)) for c, _, _ in rules]))
    return configs.select(
        *others, *[F.when(good[c], F.col(c)).otherwise(F.lit(v)).alias(c) for c, _, v in rules],
        bad.alias("repaired"), (F.col("version") == version).alias("usable"))


def runtime_checks(configs: DataFrame) -> DataFrame:
    """Validity of the runtime settings, without repair."""
    d = F.col("debounce_count").between(1, 10)
    h = F.col("hysteresis_ratio").between(0.1, 1.0)
    p = F.col("persistence_timeout").between(1, 30)
    return configs.select("*", d.alias("debounce_ok"), h.alias("hysteresis_ok"), p.alias("persistence_ok"),
                          (d & h & p).alias("valid"))


def latest(rows: DataFrame, n: int = 1) -> DataFrame:
    """Last ``n`` rows of every device; Spark limits the groups before the shuffle."""
    w = Window.partitionBy("device_id").orderBy(F.desc("ts"), F.desc("seq"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def stats_report(rows: DataFrame, history: DataFrame, score: str = "score", n: int = K.STATS_ROWS) -> DataFrame:
    """Score statistics, percentiles and recommended threshold of the last rows, with the current settings."""
    last = latest(rows, n).groupBy("device_id").agg(
        F.count(score).alias("count"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.avg(score).alias("avg"), F.stddev_pop(score).alias("stddev"),
        F.sort_array(F.collect_list(score)).alias("_s"))
    s = F.col("_s")
    enough = F.col("count") >= 50
    pct = [F.when(enough, W.percentile_lower(s, p)).alias(f"p{p}") for p in (25, 50, 75, 95)]
    # The newest configuration of a device has no end.
    now = history.where(F.col("valid_to").isNull()).select(
        "device_id", "threshold", "debounce_count", "persistence_timeout", "hysteresis_ratio")
    defaults = dict(K.CONFIG_DEFAULTS.values())
    return last.join(now, "device_id", "left").select(
        "device_id", "count", "min", "max", "avg", "stddev", *pct,
        F.when(enough, W.recommended_threshold(s)).alias("recommended_threshold"),
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(f"current_{c}")
          for c in ("threshold", "debounce_count", "persistence_timeout", "hysteresis_ratio")],
        F.when(~enough, F.format_string("ERROR: Need at least 50 samples (have %d)", F.col("count"))).alias("error"))


def info_report(history: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Current settings of a device as one JSON document.

    Of ``devices`` (any rows with a ``device_id``) those without an accepted setting report the defaults.
    """
    on = lambda c: (F.col(c) > 0).alias(c)
    cur = history.where(F.col("valid_to").isNull())
    if devices is not None:
        cur = devices.select("device_id").distinct().join(cur, "device_id", "left").fillna(dict(K.CONFIG_DEFAULTS.values()))
    return cur.select("device_id", F.to_json(F.struct(
        F.struct("threshold", F.col("debounce_count").cast("int").alias("debounce"),
                 F.col("persistence_timeout").cast("int").alias("persistence_timeout"),
                 "hysteresis_ratio").alias("detection"),
        F.col("packet_rate").cast("int").alias("traffic_generator_rate"),
        F.struct(on("butterworth_enabled"), on("wavelet_enabled"), F.col("wavelet_level").cast("int").alias("wavelet_level"),
                 "wavelet_threshold", on("hampel_enabled"), "hampel_threshold", on("savgol_enabled"),
                 on("normalizer_enabled"), "normalizer_alpha",
                 F.col("normalizer_reset_timeout").cast("int").alias("normalizer_reset_timeout")).alias("filters"),
        F.struct(on("csi_logs_enabled"), on("smart_publishing_enabled")).alias("features"))).alias("value"))
