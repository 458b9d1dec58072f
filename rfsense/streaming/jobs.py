"""Streaming counterparts of the detection and publishing jobs.

Every job holds rows until the watermark (``lateness``) has passed their bucket of time and works on them in time order; what comes for a
bucket that was given already is left out and counted. ``bucket_ms`` is the grain in which rows are held and given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.operators import control as M
from rfsense.operators.features import stateless
from rfsense.operators.scan import debounce_machine, gate_machine
from rfsense.operators.ticks import TickClock
from rfsense.session import ROCKSDB, workdir
from rfsense.sources import capture_log
from rfsense.streaming.processors import ConfigAsOf, IdleResets, InactivityAlerts, MachineProcessor, MotionDetector, PhaseCollector, TickProcessor

END = "+200000-01-01 00:00:00"
"""Time of the row that ends an input, far enough for a tolerance of thousands of years."""

SHARES = 1024
"""States over which devices are dealt. A checkpoint is bound to this number."""

CLOSING = "_closing"
"""Marks the row that ends a replayed table."""


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A table read as a stream, be it one file or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at, fs = _file_system(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return files.parquet(path)
    # A stream's path is a folder; the filter holds for names of files only.
    return files.option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path, and the store that Spark reads it from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def replay(rows: DataFrame, name: str, lateness: str = "10 seconds", grain_ms: int = 1000, files: int = 8, files_per_trigger: int = 2,
           delayed: Column | None = None) -> DataFrame:
    """A table as a stream in time order, as it would have come live: written once by ranges of ``ts``, then read a few files at a time.

    A closing row follows that moves the watermark past the first two boundaries of ``grain_ms`` after the last row, so that everything is
    given, ticks up to the first one after the table included. Rows that ``delayed`` marks come after that row: far too late for most of
    them. Rows without ``ts`` have no place in the order and are left out.
    """
    spark = rows.sparkSession
    path = workdir(spark, f"{name}-replay")
    timed = rows.where("ts is not null")
    late = F.coalesce(delayed, F.lit(False)) if delayed is not None else F.lit(False)
    last = timed.where(~late).agg(F.max(F.unix_micros("ts"))).first()[0] or 0
    grain = grain_ms * 1000
    until = (last // grain + 2) * grain + 1000
    closing = spark.range(1).select(F.timestamp_micros(F.lit(until)).alias("ts"), F.lit(True).alias(CLOSING))
    closing = closing.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {lateness}"))
    timed.where(~late).withColumn(CLOSING, F.lit(None).cast("boolean")).repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(path)
    parts = [*_ordered(spark, path)]
    unmarked = timed.limit(0).withColumn(CLOSING, F.lit(None).cast("boolean"))
    unmarked.unionByName(closing, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    parts += [p for p in _ordered(spark, path) if p not in parts]
    if delayed is not None:
        timed.where(late).withColumn(CLOSING, F.lit(None).cast("boolean")).coalesce(1).write.mode("append").parquet(path)
        parts += [p for p in _ordered(spark, path) if p not in parts]
    # A stream takes files in the order of their times; the names of the first ones are in the order of their ranges.
    for k, part in enumerate(parts):
        at, fs = _file_system(spark, part)
        fs.setTimes(at, 1_600_000_000_000 + 1000 * k, -1)
    # The closing row is a trigger of its own: what came before must not wait for it, nor what is late come with it.
    return spark.readStream.schema(unmarked.schema).option("maxFilesPerTrigger", files_per_trigger if delayed is None else 1).parquet(path)


def _ordered(spark: SparkSession, path: str) -> list[str]:
    at, fs = _file_system(spark, path)
    return sorted(str(f.getPath().toString()) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))


def _marked(rows: DataFrame, lateness: str, end: DataFrame | None = None) -> DataFrame:
    """Rows under a watermark, without the one that ends the input: it has moved the watermark and goes no further."""
    if end is not None:
        rows = rows.unionByName(end, allowMissingColumns=True)
    rows = rows.withWatermark("ts", lateness)
    # One condition that reads ``ts``: it stays above the watermark, which must see the row.
    if CLOSING in rows.columns:
        rows = rows.where(F.when(F.col("ts").isNotNull(), F.col(CLOSING).isNull()).otherwise(False)).drop(CLOSING)
    return rows.where(F.col("ts") < F.lit(END).cast("timestamp"))


def _within(rows: DataFrame, lateness: str, end: DataFrame | None) -> DataFrame:
    """``_marked``, with a ``ts`` that Spark does not drop late rows by: the processors count them. Rows without ``ts`` have no place in the order."""
    ends = end is not None or CLOSING in rows.columns
    rows = _marked(rows, lateness, end)
    if ends:  # else conditions on other columns, which the row that ends the input does not meet, would go below the watermark
        rows = rows.withColumns({c: F.when(F.col("ts").isNotNull(), F.col(c)) for c in rows.columns if c != "ts"})
    return rows.withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))


def _stateful(rows: DataFrame, processor, output: str) -> DataFrame:
    """Devices are dealt by hash over ``SHARES`` states; ``device_id`` comes back with the type it has in the input."""
    dealt = rows.withColumns({"device_share": F.pmod(F.xxhash64("device_id"), F.lit(SHARES)), "device_id": F.col("device_id").cast("string")})
    out = dealt.groupBy("device_share").transformWithStateInPandas(processor, outputStructType=f"device_id string, {output}", outputMode="append", timeMode="eventTime")
    return out.withColumn("device_id", F.col("device_id").cast(rows.schema["device_id"].dataType))


def detections(packets: DataFrame, threshold: float = 0.5, debounce: int = 10, persistence: int = 3,
               delta: float = K.PUBLISH_DELTA, heartbeat_ms: int = K.PUBLISH_HEARTBEAT_MS, lateness: str = "10 seconds",
               end: DataFrame | None = None, bucket_ms: int = 1000) -> DataFrame:
    """State, confidence and publish flag of every packet; the only shuffle is by device. ``late`` counts the device's late rows so far."""
    feats = stateless(_within(packets, lateness, end), ("variance", "iqr", "spatial_gradient"), *K.SUBCARRIER_RANGE)
    machine = MotionDetector(debounce_machine(debounce, persistence), gate_machine(delta, heartbeat_ms), threshold, bucket_ms)
    return _stateful(feats, machine, "ts timestamp, seq bigint, score double, state string, confidence double, published boolean, late bigint")


def debounced(scored: DataFrame, threshold: float, debounce: int = 10, persistence: int = 3, lateness: str = "10 seconds", end: DataFrame | None = None,
              bucket_ms: int = 1000) -> DataFrame:
    """States of a scored stream."""
    rows = _within(scored, lateness, end).select("device_id", "ts", "seq", "score", (F.col("score") > threshold).alias("above"))
    machine = MachineProcessor(debounce_machine(debounce, persistence), "score double, above boolean", ("score",), bucket_ms)
    return _stateful(rows, machine, "ts timestamp, seq bigint, score double, state string, downgraded boolean")


def gated(states: DataFrame, delta: float = K.PUBLISH_DELTA, heartbeat_ms: int = K.PUBLISH_HEARTBEAT_MS, lateness: str = "10 seconds", end: DataFrame | None = None,
          bucket_ms: int = 1000) -> DataFrame:
    """Publish flags of a state stream."""
    rows = _within(states, lateness, end).select("device_id", "ts", "seq", "state", "score")
    machine = MachineProcessor(gate_machine(delta, heartbeat_ms), "state string, score double", ("state", "score"), bucket_ms)
    return _stateful(rows, machine, "ts timestamp, seq bigint, state string, score double, published boolean")


def ticks(states: DataFrame, period_seconds: int = 1, lateness: str = "10 seconds", bucket_ms: int = 1000) -> DataFrame:
    """Latest state, score and confidence at every tick, also at those without a row: a timer per device gives them as the watermark passes."""
    rows = _within(states, lateness, None).select("device_id", "ts", "seq", "state", "score", "confidence")
    machine = TickProcessor(period_seconds * 1000, "state string, score double, confidence double", bucket_ms)
    runs = _stateful(rows, machine, "first bigint, last bigint, state string, score double, confidence double")
    at = F.timestamp_micros(F.col("tick") * F.lit(period_seconds * 1_000_000))
    return (runs.select("device_id", F.explode(F.sequence("first", "last")).alias("tick"), "state", "score", "confidence")
            .select("device_id", at.alias("ts"), "state", "score", "confidence"))


def idle_resets(states: DataFrame, timeout: int, period_seconds: int = 1, lateness: str = "10 seconds", bucket_ms: int = 1000) -> DataFrame:
    """The ticks at which an idle device is reset (``operators.ticks``), numbered, also when no row comes."""
    rows = _within(states, lateness, None).select("device_id", "ts", "seq", "state")
    return _stateful(rows, IdleResets(TickClock(timeout * 1000, period_seconds * 1000), bucket_ms), "reset_ts timestamp, resets bigint")


def inactivity_alerts(states: DataFrame, hours: float = 4.0, from_hour: int = 8, to_hour: int = 22, lateness: str = "10 seconds", bucket_ms: int = 1000) -> DataFrame:
    """An alert at the moment a device has been idle for ``hours``, if that lies in the given hours of the day (UTC), also when no row comes."""
    rows = _within(states, lateness, None).select("device_id", "ts", "seq", "state")
    return _stateful(rows, InactivityAlerts(int(hours * 3_600_000), from_hour, to_hour, bucket_ms), "idle_since timestamp, alert_ts timestamp")


def phases(packets: DataFrame, samples: int, lateness: str = "10 seconds", bucket_ms: int = 1000) -> DataFrame:
    """Phase and number of every row, counted in the state; ``begins`` marks the first row of a phase, and the one after the last phase."""
    if not 50 <= samples <= 10000:
        raise ValueError("samples must be within 50..10000")
    rows = _within(packets, lateness, None).select("device_id", "ts", "seq")
    return _stateful(rows, PhaseCollector(samples, bucket_ms), "ts timestamp, seq bigint, phase string, sample_in_phase bigint, begins boolean")


def config_as_of(rows: DataFrame, messages: DataFrame, keep: str = "score double", cols: tuple[str, ...] = ("threshold", "debounce_count", "persistence_timeout"),
                 lateness: str = "10 seconds", bucket_ms: int = 1000) -> DataFrame:
    """Rows with the configuration in force, from a live stream of command messages: both inputs meet in one state per device.

    A row sees the commands up to its own time; the defaults hold before a device's first command. ``keep``: DDL of the columns to keep. The watermark is that of
    the slower input.
    """
    own = [f.split()[0] for f in keep.split(", ")]
    sets = M.validate(_within(messages, lateness, None)).where("accepted")
    settings = {cmd: (col, default) for cmd, (col, default) in K.CONFIG_DEFAULTS.items() if col in cols}
    null = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in keep.split(", ")]
    commands = sets.where(F.col("cmd").isin(*settings, "factory_reset")).select("device_id", "ts", "seq", F.lit(0).alias("kind"), "cmd", "setting", *null)
    data = _within(rows, lateness, None).select("device_id", "ts", "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("cmd"), F.lit(None).cast("double").alias("setting"), *own)
    machine = ConfigAsOf(settings, keep, bucket_ms)
    return _stateful(commands.unionByName(data), machine, f"ts timestamp, seq bigint, {keep}, " + ", ".join(f"{c} double" for c, _ in settings.values()))


def packet_rate(packets: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Packets per device and second.

    In append mode a second is given once it can get no more rows; in update mode at once, and again as it grows.
    """
    return (_marked(packets, lateness).groupBy("device_id", F.window("ts", "1 second").alias("w"))
            .agg(F.count(F.lit(1)).alias("received"))
            .select("device_id", F.col("w.start").alias("second"), "received"))


def active_ticks(states: DataFrame, period: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Latest values of every tick that had a packet; modes as in ``packet_rate``."""
    newest = F.struct("ts", "seq")
    return (_marked(states, lateness).groupBy("device_id", F.window("ts", period).alias("w"))
            .agg(F.max_by("state", newest).alias("state"), F.max_by("score", newest).alias("score"))
            .select("device_id", F.col("w.end").alias("tick"), "state", "score"))


def capture(packets: DataFrame, enabled: bool = True) -> DataFrame:
    """Capture-log lines of a packet stream."""
    return capture_log.render(packets, enabled)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, fmt: str = "parquet", base: str | None = None, progress: list | None = None) -> DataFrame:
    """Process what is there now into a table in the shared folder and read it back; a run with the ``base`` of another goes on from it.

    ``progress`` gets what Spark reports of the micro-batches.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = base or workdir(spark, name)
    q = (stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return spark.read.schema(stream.schema).format(fmt).load(f"{base}/out")


def run_to_end(spark: SparkSession, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """A job over an input that ends: all there is now, then one row of time ``END``, which lets go what waits for the watermark.

    ``job`` gets the stream of that row, to pass on as ``end``. A live stream has none; its last rows wait until later ones
    move the watermark on.
    """
    ends, base = workdir(spark, f"{name}-end"), workdir(spark, name)
    spark.createDataFrame([], "ts timestamp").write.parquet(ends)
    stream = job(spark.readStream.schema("ts timestamp").parquet(ends))
    # The batch without data that follows the last one is left to the second run.
    quiet = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(quiet)
    spark.conf.set(quiet, "false")
    try:
        run_to_table(spark, stream, name, base=base)
    finally:
        spark.conf.set(quiet, before)
    spark.range(1).select(F.lit(END).cast("timestamp").alias("ts")).write.mode("append").parquet(ends)
    return run_to_table(spark, stream, name, base=base)


def run_to_latest(spark: SparkSession, stream: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Process what is there now in update mode; the newest row of every key, also of windows that are still open.

    Each micro-batch writes a folder of its own, which a repeated one replaces.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = workdir(spark, name)
    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(-1).cast("long")).write.parquet(f"{base}/out/none")

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{batch}")

    q = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).foreachBatch(save).start())
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    newest = spark.read.parquet(f"{base}/out/*").groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return newest.select(*keys, "_r.*").select(*stream.columns)
