"""Stratified split, histogram of all features at once, one feature pass for calibration and scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.operators import evaluate as E
from rfsense.operators import forest
from rfsense.operators.features import features, long_form
from rfsense.plans import pipelines as L
from rfsense.sources import tables
from tests.conftest import SF


@pytest.mark.parametrize("bins", [1 << 16, 2])
def test_split_is_exact(spark, monkeypatch, bins):
    """The rows with the lowest hashes of each class; with few bins most rows are ranked inside one."""
    monkeypatch.setattr(forest, "BINS", bins)
    rows = [(i % 3, "BASELINE" if i < 700 else "MOVEMENT" if i < 707 else "OTHER", i) for i in range(708)]
    out = forest.split(spark.createDataFrame(rows, "device_id long, phase string, start_pos long"))
    got = out.withColumn("h", F.xxhash64("device_id", "phase", "start_pos", F.lit(forest.SEED))).collect()
    assert len(got) == len(rows) and out.columns == ["device_id", "phase", "start_pos", "is_test"]
    for phase, n in (("BASELINE", 210), ("MOVEMENT", 2), ("OTHER", 0)):
        own = sorted((r for r in got if r.phase == phase), key=lambda r: r.h & (2**64 - 1))
        assert [r.is_test for r in own] == [True] * n + [False] * (len(own) - n)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_wide_histogram(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(i % 4, "MOVEMENT" if rng.random() < 0.4 else "BASELINE", float(v), float(np.round(v * 3)), 1.5) for i, v in enumerate(rng.standard_normal(3000))]
    rows += [(9, "BASELINE", 0.0, 1.0, 2.0)]
    feats = spark.createDataFrame(rows, "device_id long, phase string, a double, b double, c double").withColumn("device_id", F.col("device_id").cast(kind)).repartition(3)
    names = ("a", "b", "c")

    def sorted_rows(h):
        return sorted((r.device_id, r.feature_idx, r.feature, r.lo, r.hi, r.step, r.bucket, r.m, r.b, round(r.s, 6)) for r in h.collect())

    assert sorted_rows(E.wide_histogram(feats, names)) == sorted_rows(E.histogram(long_form(feats, ("device_id", "phase"), names)))


def test_wide_histogram_of_nothing(spark):
    feats = features(tables.packets(spark, SF).where("seq < 0"))
    assert E.otsu(E.wide_histogram(feats, K.FEATURES)).count() == 0


def test_calibrated_detections_read_the_packets_features_once(spark):
    d = L.calibrated_detections(tables.packets(spark, SF), 0.53, 2, 1)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "embeddings.parquet" not in plan and d.count() == tables.packets(spark, SF).count()


def test_hot_devices_with_packets_that_are_not_admitted(spark, small_pieces):
    """Look-back counts admitted packets only, also where a device is cut."""
    n = F.when(F.col("seq") % 3 > 0, 8).otherwise(64)
    packets = tables.packets(spark, SF).withColumn("iq", F.slice("iq", 1, n))

    def rows(d):
        return sorted((r.device_id, r.seq, round(r.score, 9), r.state) for r in d.collect())

    assert rows(L.motion_detections(packets, 0.53, 2, 1)) == rows(L.motion_detections(packets, 0.53, 2, 1, piece_rows=10**6))
    assert rows(L.calibrated_detections(packets, 0.53, 2, 1)) == rows(L.calibrated_detections(packets, 0.53, 2, 1, piece_rows=10**6))
