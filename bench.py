"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from metricwatch.catalog import QUERIES
from metricwatch.session import local_session

HEADLINE = (
    "dynamics_daily", "dynamics_weekly", "legacy_baseline_daily", "resample_hourly", "interpolate_gaps",
    "bucket_hampel", "series_median_mad", "outlier_lite", "rolling_statistics", "choose_profile_buckets",
    "purge_bucket_outliers", "l1_filter", "kpss_test", "mann_kendall", "classify_series", "detection_quality",
    "isolation_forest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the workers
    times = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
