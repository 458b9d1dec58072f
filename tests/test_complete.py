"""Rows that are easily left out: short packets, devices of one phase, devices without settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfsense import constants as K
from rfsense.operators import calibrate as C
from rfsense.operators import control as M
from rfsense.operators import spectral as X


def test_covariance_counts_short_packets_and_takes_text_ids(spark):
    rng = np.random.default_rng(5)
    iq = [("a" if k % 3 else "b", "MOVEMENT", rng.integers(-90, 90, (2, 6, 8)[k % 3 if k % 5 else 0]).tolist()) for k in range(60)]
    iq += [("a", "MOVEMENT", []), ("a", "MOVEMENT", None), ("a", "BASELINE", [1, 2]), ("c", "MOVEMENT", [1, 2])]
    df = spark.createDataFrame(iq, "device_id string, phase string, iq array<int>").repartition(4)
    got = {(r["device_id"], r["i"], r["j"]): (r["cov"], r["packets"]) for r in X.pair_covariance(df).collect()}
    want = {}
    for d in "ab":
        amps = [np.hypot(*np.reshape(v, (-1, 2)).T) for name, phase, v in iq if name == d and phase == "MOVEMENT" and v]
        for j in range(max(map(len, amps))):
            have = np.array([a[:j + 1] for a in amps if len(a) > j])
            for i in range(j + 1):
                if len(have) > 1:
                    want[d, i, j] = (np.cov(have[:, i], have[:, j])[0, 1], len(have))
    assert got.keys() == want.keys()
    for k, (cov, n) in want.items():
        assert got[k] == (pytest.approx(cov, rel=1e-9, abs=1e-9), n)
    assert X.pca(X.covariance(df), 1).select("device_id").distinct().count() == 2
    assert X.covariance(df.limit(0)).count() == 0


def test_devices_of_one_phase_get_a_failed_row(spark):
    rows = [("a", p, 0, "variance", 60, 1.0 + k, 0.5, 0.0, 5.0) for k, p in enumerate(C.PHASES)]
    rows += [("b", "BASELINE", 0, "variance", 60, 1.0, 0.5, 0.0, 5.0)]
    stats = spark.createDataFrame(rows, "device_id string, phase string, feature_idx int, feature string, n long, mean double, "
                                        "var double, min double, max double")
    got = {r["device_id"]: tuple(r)[1:] for r in C.status(stats, C.model(C.paired(stats))).collect()}
    assert got == {"a": (60, 60, "DONE", ""), "b": (60, 0, "FAILED", "insufficient samples")}


def test_devices_without_settings_report_the_defaults(spark):
    log = spark.createDataFrame([(1, 1, '{"cmd":"threshold","value":0.3}'), (2, 2, '{"cmd":"threshold","value":9}')],
                                "device_id long, seq long, message string").withColumn("ts", F.timestamp_seconds("seq"))
    out = M.info_report(M.config_history(M.validate(log)), log)
    got = {r["device_id"]: r["t"] for r in out.select(
        "device_id", F.get_json_object("value", "$.detection.threshold").cast("double").alias("t")).collect()}
    assert got == {1: 0.3, 2: K.CONFIG_DEFAULTS["threshold"][1]}
