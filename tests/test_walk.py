"""Groups spread over many Arrow batches give the same results as in one."""

import check
import pytest

import __spark_entry__ as entry
from tests.conftest import SF


@pytest.mark.parametrize("name", ["series_detections", "ewma_reset", "lowpass_big", "motion_segments", "publish_gate",
                                  "motion_detections", "temporal_deltas_mixed", "covariance"])
def test_small_batches(spark, name):
    whole = entry.queries()[name](spark, SF).toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = entry.queries()[name](spark, SF).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert check.compare(cut, whole) == ""


def test_one_walk_equals_the_separate_steps(spark):
    from rfsense.plans.pipelines import motion_detections, rounded
    from rfsense.plans.queries import mixed_packets

    p = mixed_packets(spark, SF)
    one = motion_detections(p, 0.5, 2, 1)
    cut = motion_detections(p, 0.5, 2, 1, piece_rows=60)
    assert check.compare(rounded(one).toPandas(), rounded(cut).toPandas()) == ""
