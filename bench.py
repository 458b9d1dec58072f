"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores,
BENCH_QUERIES (comma separated) other queries. Each query is run once to warm up and timed
on the second run, into a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rfsense.plans.queries import QUERIES  # noqa: E402
from rfsense.session import build  # noqa: E402

HEADLINE = (
    "packet_features", "temporal_deltas", "moving_moments", "hampel", "rolling_stats", "rolling_percentiles",
    "lowpass_big", "ewma", "ewma_reset", "filter_cascade", "wavelet_sliding", "motion_detections",
    "series_detections", "tick_samples", "publish_gate", "calibration_summary", "calibrated_detections",
    "motion_segments", "grid_search", "confusion", "covariance", "doppler_features", "config_history",
    "config_asof", "status_reports", "stream_detections",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                  spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - t0, 3)
    packets = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    extra = {"packets_per_sec": {n: round(packets / took[n]) for n in ("packet_features", "motion_detections") if n in took}}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf, **extra}))


if __name__ == "__main__":
    main()
