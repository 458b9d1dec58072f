"""Every named query against its SQL, and the ordered ones again with all devices cut into pieces."""

import glob
import os

import check
import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

ORACLES = entry.oracle_sql()

ORDERED = ["temporal_deltas_mixed", "moving_moments", "hampel", "savgol", "moving_variance", "lowpass_big", "wavelet_sliding",
           "wavelet_block", "motion_detections", "series_detections", "tick_samples", "publish_gate", "movement_alerts",
           "inactivity_alerts", "phase_assignment", "phase_events", "motion_segments", "segment_features", "grid_search",
           "warmup_skip", "doppler_features", "config_history", "ewma_reset"]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in ORACLES:
        assert check.compare(got, con.sql(ORACLES[name]).df()) == ""
    else:
        assert len(got) > 0


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_hot_devices(spark, con, small_pieces, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert check.compare(got, con.sql(ORACLES[name]).df()) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 500 and "state" in df.columns
