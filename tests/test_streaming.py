"""Streams split into many small batches give the batch results; late rows are left out and counted."""

import pytest
from pyspark.sql import functions as F

from rfsense.operators import detect as D
from rfsense.plans import pipelines as L
from rfsense.plans.queries import QUERIES
from rfsense.session import workdir
from rfsense.sources import capture_log, tables
from rfsense.streaming import jobs as J
from tests.conftest import SF


@pytest.fixture(scope="module")
def packet_files(spark):
    """The packet table as ten files in time order."""
    path = workdir(spark, "packets")
    p = tables.packets(spark, SF).orderBy("seq")
    for i in range(10):
        p.where(F.col("seq").between(i * 50, i * 50 + 49)).coalesce(1).write.mode("append").parquet(path)
    return path


def read(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_detections_over_many_batches(spark, packet_files):
    out = J.run_to_end(spark, lambda end: J.detections(read(spark, packet_files), 0.53, 2, 1, heartbeat_ms=500, end=end), "t1")
    batch = L.motion_detections(tables.packets(spark, SF), 0.53, 2, 1)
    assert rows(out, "device_id", "seq", "score", "state", "confidence") == rows(
        batch, "device_id", "seq", "score", "state", "confidence")
    gate = D.gate(batch, heartbeat_ms=500)
    assert rows(out, "device_id", "seq", "published") == rows(gate, "device_id", "seq", "published")


def test_rate_gives_every_second(spark, packet_files):
    out = J.run_to_latest(spark, J.packet_rate(read(spark, packet_files)), ("device_id", "second"), "t10")
    batch = tables.packets(spark, SF).groupBy("device_id", F.date_trunc("second", "ts").alias("second")).count()
    assert rows(out, "device_id", "second", "received") == rows(batch, "device_id", "second", "count")


def test_detections_of_text_ids(spark, packet_files):
    named = read(spark, packet_files).withColumn("device_id", F.concat(F.lit("d"), "device_id"))
    out = J.run_to_end(spark, lambda end: J.detections(named, 0.53, 2, 1, end=end), "t11")
    batch = L.motion_detections(tables.packets(spark, SF), 0.53, 2, 1).withColumn("device_id", F.concat(F.lit("d"), "device_id"))
    assert rows(out, "device_id", "seq", "state") == rows(batch, "device_id", "seq", "state")


def test_machines_over_many_batches(spark, packet_files):
    batch = L.motion_detections(tables.packets(spark, SF), 0.53, 2, 1).select("device_id", "ts", "seq", "score", "state")
    path = workdir(spark, "scored")
    for i in range(5):
        batch.where(F.col("seq").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(path)
    s = J.run_to_end(spark, lambda end: J.debounced(read(spark, path), 0.53, 2, 1, end=end), "t2")
    assert rows(s, "device_id", "seq", "state") == rows(batch, "device_id", "seq", "state")
    g = J.run_to_end(spark, lambda end: J.gated(read(spark, path), end=end), "t3")
    assert rows(g, "device_id", "seq", "published") == rows(D.gate(batch), "device_id", "seq", "published")


def _states(spark, *batches):
    path = workdir(spark, "states")
    for b in batches:
        spark.createDataFrame(b, "device_id long, sec long, seq long, state string, score double").select(
            "device_id", F.timestamp_seconds("sec").alias("ts"), "seq", "state", "score").coalesce(1) \
            .write.mode("append").parquet(path)
    return read(spark, path)


def test_late_rows_are_left_out(spark):
    # Another device moves the watermark on, which lets the first rows go; the late one comes after that.
    s = _states(spark, [(1, 10, 1, "IDLE", 0.1), (1, 11, 2, "IDLE", 0.5)], [(2, 20, 5, "IDLE", 0.1)], [(2, 21, 6, "IDLE", 0.1)],
                [(1, 9, 3, "IDLE", 0.9), (1, 12, 4, "IDLE", 0.5)])
    out = J.run_to_end(spark, lambda end: J.gated(s, lateness="0 seconds", end=end), "t5").where("device_id = 1")
    assert rows(out, "seq", "published") == [(1, True), (2, True), (4, False)]


def test_rows_within_the_tolerance_are_not_late(spark):
    s = _states(spark, [(1, 10, 1, "IDLE", 0.1), (1, 11, 2, "IDLE", 0.5)], [(1, 9, 3, "IDLE", 0.9), (1, 12, 4, "IDLE", 0.5)])
    out = J.run_to_end(spark, lambda end: J.gated(s, end=end), "t12")
    assert rows(out, "seq", "published") == [(1, True), (2, True), (3, True), (4, False)]


@pytest.mark.parametrize("order", [reversed, list])
def test_many_files_in_any_order(spark, order):
    """125 files over 25 seconds; the tolerance holds them all."""
    path = workdir(spark, "many")
    p = tables.packets(spark, SF)
    for i in order(range(125)):
        p.where(F.col("seq").between(i * 4, i * 4 + 3)).coalesce(1).write.mode("append").parquet(path)
    files = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 40).parquet(path)
    out = J.run_to_end(spark, lambda end: J.detections(files, 0.53, 2, 1, heartbeat_ms=500, lateness="30 seconds", end=end), "t13")
    batch = D.gate(L.motion_detections(p, 0.53, 2, 1), heartbeat_ms=500)
    assert rows(out, "device_id", "seq", "state", "published", "late") == rows(batch.withColumn("late", F.lit(0)), "device_id", "seq", "state", "published", "late")


def test_late_packets_are_counted(spark):
    """A file older than the tolerance, after rows that came later were given: its rows are counted in the rows that follow."""
    path = workdir(spark, "late")
    p = tables.packets(spark, SF).where("device_id = 0")
    for low, high in ((200, 299), (300, 399), (400, 449), (0, 19), (450, 499)):
        p.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(path)
    files = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = J.run_to_end(spark, lambda end: J.detections(files, 0.53, 2, 1, lateness="0 seconds", end=end), "t14")
    assert out.count() == p.where("seq >= 200").count()
    assert out.agg(F.max("late")).first()[0] == p.where("seq < 20").count()


@pytest.fixture(scope="module")
def folder_tables(spark):
    """The tables as folders of part files, rows dealt by a hash over more files than two triggers take."""
    path = workdir(spark, "folders")
    for name, key in (("embeddings", "vec_id"), ("events", "event_id")):
        tables.table(spark, SF, name).repartition(400, F.xxhash64(key)).write.parquet(f"{path}/{name}.parquet")
    return path


def test_folder_tables_give_all_rows(spark, folder_tables):
    for name in ("embeddings", "events"):
        out = J.run_to_table(spark, J.stream_table(spark, folder_tables, name), f"folder-{name}")
        assert out.count() == tables.table(spark, SF, name).count()


@pytest.mark.parametrize("stream, batch", [("stream_detections", "motion_detections"), ("stream_publish", None), ("stream_series_detections", None),
                                           ("stream_packet_rate", None)])
def test_queries_over_many_files_in_any_order(spark, folder_tables, stream, batch):
    """With the settings of the queries themselves: four triggers of 100 files give what one trigger gives, or the batch."""
    got, want = QUERIES[stream](spark, folder_tables), QUERIES[batch or stream](spark, SF)
    assert rows(got, *got.columns) == rows(want, *got.columns)


def test_late_rows_are_given(spark, folder_tables):
    got, want = (rows(QUERIES["stream_late"](spark, sf), "device_id", "received", "late") for sf in (folder_tables, SF))
    assert got == want and sum(late for *_, late in got) > 0


def _reset_at(spark, s, name):
    out = J.run_to_table(spark, J.idle_resets(s, 30), name)
    return rows(out.withColumn("at", F.unix_seconds("reset_ts")), "device_id", "at", "resets")


def test_resets_come_without_rows_of_the_device(spark):
    s = _states(spark, [(1, 10, 1, "DETECTED", 0.9), (1, 11, 2, "IDLE", 0.1), (2, 10, 2, "DETECTED", 0.9)], [(2, 100, 3, "DETECTED", 0.9)], [(2, 101, 4, "IDLE", 0.1)])
    assert _reset_at(spark, s, "t6") == [(1, 40, 1), (1, 70, 2)]


def test_resets_wait_while_a_device_moves(spark):
    s = _states(spark, [(1, 10, 1, "DETECTED", 0.9)], [(2, 100, 1, "IDLE", 0.1)], [(2, 200, 2, "IDLE", 0.1)])
    assert _reset_at(spark, s, "t9") == []


def test_ticks_go_on_for_silent_devices(spark):
    s = _states(spark, [(1, 10, 1, "DETECTED", 0.9), (1, 10, 2, "IDLE", 0.2), (1, 13, 3, "IDLE", 0.3)], [(2, 20, 1, "IDLE", 0.1)], [(2, 27, 2, "IDLE", 0.1)], [(2, 28, 3, "IDLE", 0.1)])
    out = J.run_to_table(spark, J.ticks(s.withColumn("confidence", F.lit(1.0)), 1, "2 seconds"), "t15")
    got = rows(out.withColumn("at", F.unix_seconds("ts")), "device_id", "at", "score")
    assert [r for r in got if r[0] == 1] == [(1, t, 0.2 if t < 13 else 0.3) for t in range(10, 26)]


def test_an_alert_is_cancelled_by_movement(spark):
    day = [(1, 0, 1, "IDLE", 0.1), (2, 0, 1, "IDLE", 0.1), (3, 0, 1, "DETECTED", 0.1)]
    s = _states(spark, day, [(1, 3 * 3600, 2, "DETECTED", 0.9), (3, 3 * 3600, 2, "DETECTED", 0.9)], [(3, 9 * 3600, 3, "IDLE", 0.1)], [(3, 10 * 3600, 4, "IDLE", 0.1)])
    out = J.run_to_table(spark, J.inactivity_alerts(s, 4.0, 0, 24), "t16")
    assert rows(out.withColumn("at", F.unix_seconds("alert_ts")), "device_id", "at") == [(2, 4 * 3600)]


def test_stream_ticks_hold_those_of_the_batch(spark):
    live, batch = (set(rows(QUERIES[q](spark, SF), "device_id", "ts", "state", "score", "confidence")) for q in ("stream_ticks", "tick_samples"))
    last = {}
    for device, ts, *_ in batch:
        last[device] = max(ts, last.get(device, 0))
    assert {r for r in live if r[1] <= last[r[0]]} == batch and len(live) > len(batch)


def test_stream_resets_are_those_of_the_epochs(spark):
    epochs = rows(QUERIES["ewma_reset"](spark, SF), "device_id", "seq", "epoch")
    at = {(r.device_id, r.seq): r.us for r in tables.series(spark, SF).select("device_id", "seq", F.unix_micros("ts").alias("us")).collect()}
    resets = rows(QUERIES["stream_idle_resets"](spark, SF), "device_id", "reset_ts")
    assert all(epoch == sum(d == device and t < at[device, seq] for d, t in resets) for device, seq, epoch in epochs)


def test_the_state_is_bounded_by_the_tolerance(spark):
    """Half a second a trigger; rows in the state, by what Spark reports."""
    packets, most = tables.packets(spark, SF), {}
    for lateness in ("2 seconds", "60 seconds"):
        progress = []
        stream = J.detections(J.replay(packets, "bound", lateness, files=50, files_per_trigger=1), 0.53, 2, 1, lateness=lateness)
        out = J.run_to_table(spark, stream, "bound", progress=progress)
        assert out.count() == packets.count()
        most[lateness] = max(o["numRowsTotal"] for p in progress for o in p["stateOperators"])
    assert most["2 seconds"] < 0.4 * most["60 seconds"]


def test_many_devices_share_states(spark, monkeypatch):
    """400 devices of five rows: the state grows by shares, not by devices, and every device has its own machine."""
    monkeypatch.setattr(J, "SHARES", 4, raising=False)
    scored = spark.range(2000).select((F.col("id") % 400).alias("device_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").alias("seq"),
                                      (F.col("id") * 37 % 10 / 10).alias("score"))
    progress = []
    out = J.run_to_table(spark, J.debounced(J.replay(scored, "shares"), 0.53, 1, 1), "shares", progress=progress)
    batch = D.detect(scored, 0.53, 1, 1)
    assert rows(out, "device_id", "seq", "state") == rows(batch, "device_id", "seq", "state")
    assert len({r[0] for r in rows(out, "state")}) == 2
    assert 0 < max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) < 100


def test_active_ticks(spark):
    s = _states(spark, [(1, 0, 1, "IDLE", 0.1), (1, 0, 2, "DETECTED", 0.8)], [(1, 60, 3, "IDLE", 0.2)], [(1, 90, 4, "IDLE", 0.2)])
    out = J.run_to_table(spark, J.active_ticks(s), "t7")
    assert (1, "DETECTED", 0.8) in rows(out, "device_id", "state", "score")


def test_capture_log_stream(spark, packet_files):
    path = workdir(spark, "lines")
    capture_log.write(tables.packets(spark, SF), path)
    out = J.run_to_table(spark, capture_log.read_stream(spark, path), "t8")
    assert out.count() == 500


def test_capture_log_rejects_bad_lines(spark):
    lines = spark.createDataFrame([("CSI|BASELINE|1,-2,3",), ("",), ("XXX|BASELINE|1",), ("CSI|IDLE|1",), ("CSI|MOVEMENT",),
                                   (" CSI|MOVEMENT|7 ",)], "value string")
    assert [(r.phase, r.iq) for r in capture_log.parse(lines).collect()] == [("BASELINE", [1, -2, 3]), ("MOVEMENT", [7])]
