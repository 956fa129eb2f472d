import random

import numpy as np

from metricwatch.operators import robust_buckets
from metricwatch.sources import labels


def samples_of(spark, seed):
    rng, rows = random.Random(seed), []
    for name, n, spread in (("a", 400, 1.0), ("b", 37, 5.0), ("c", 3, 1.0), ("d", 90, 0.0), ("e", 200, 2.0)):
        for i in range(n):
            v = 100 + spread * rng.gauss(0, 1)
            if name in "ae" and i % 9 == 0:
                v += rng.choice([20, 60, 400, -900])
            rows.append((name, i % 2, i, None if i % 50 == 49 else round(v, 3)))
    return spark.createDataFrame(rows, "series_id string, bucket int, ts long, value double")


def test_rounds_equal_what_a_task_does(spark, monkeypatch):
    samples = samples_of(spark, 1)
    take = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    ranges, stats = take(robust_buckets.keep_ranges(samples, 3.0, 5)), take(robust_buckets.bucket_stats(samples, 3.0, 5))
    assert len(ranges) == 10
    monkeypatch.setattr(robust_buckets, "LARGE", 30)  # some buckets in tasks, some in rounds
    assert take(robust_buckets.keep_ranges(samples, 3.0, 5)) == ranges
    assert take(robust_buckets.bucket_stats(samples, 3.0, 5)) == stats


def test_a_bucket_beyond_the_bound_is_never_gathered(spark):
    """Two million values in one bucket."""
    rows = spark.range(2_000_000).selectExpr("'s' AS series_id", "0 AS bucket", "id AS ts", "CASE WHEN id % 1000 = 7 THEN 1e6 + id ELSE (id * 7919 % 1999993) / 1e4 END AS value")
    counts, large = robust_buckets._split(rows, ["series_id", "bucket"])
    assert counts.count() == 0 and large.count() == 2_000_000
    found = robust_buckets.keep_ranges(rows, 3.5, 5).collect()
    x = np.array([(i * 7919 % 1999993) / 1e4 for i in range(2_000_000) if i % 1000 != 7])
    assert [(r.keep_from, r.keep_to) for r in found] == [(x.min(), x.max())]


def test_overlapping_windows_are_one(spark):
    windows = [("a", 10, 20), ("a", 15, 40), ("a", 12, 13), ("a", 41, 45), ("a", 50, 60), ("b", 5, 86_400 * 3 + 5), ("b", 7, 8), ("c", 9, 3), ("c", None, 4), ("a", 10, 20)]
    frame = spark.createDataFrame(windows, "series_id string, start_ts long, end_ts long")
    merged = sorted(tuple(r) for r in labels.merged_windows(frame).collect())
    assert merged == [("a", 10, 45), ("a", 50, 60), ("b", 5, 86_400 * 3 + 5)]
    points = [(s, t, float(t), "x") for s in "abc" for t in (0, 4, 5, 9, 10, 14, 40, 41, 45, 46, 49, 50, 60, 61, 86_400, 86_400 * 3 + 5, 86_400 * 3 + 6)]
    got = labels.label_by_windows(spark.createDataFrame(points, "series_id string, ts long, value double, _window_name string"), frame)
    want = [(*p, int(any(s == p[0] and a is not None and a <= p[1] <= b for s, a, b in windows))) for p in points]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert labels.label_by_windows(got.drop("label"), frame.limit(0)).where("label = 1").count() == 0
