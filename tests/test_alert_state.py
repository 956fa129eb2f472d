import os

import pytest
from pyspark.sql import functions as F

from metricwatch.options import FunnelOptions
from metricwatch.sources import alerts, store
from metricwatch.streaming import online

DAY = 86_400
OPTIONS = FunnelOptions(trend="daily", bucket_slot_secs=3_600, lookback_days=7, eval_window_secs=2 * DAY, alert_output_mode="dedupe")


def level(ts, series):
    return 50.0 + (ts // 60 * 7 + len(series)) % 11


def window(points, start, secs, series=("a", "b"), spikes=(), step=60):
    return points([(s, t, 500.0 if (s, t) in spikes else level(t, s)) for s in series for t in range(start, start + secs, step)])


def flags(df):
    return sorted((r.series_id, r.ts) for r in df.where("anomaly = 1").collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_overlapping_windows_count_points_and_alerts_once(spark, points, tmp_path):
    root, t0 = str(tmp_path), 1000 * DAY
    history = window(points, t0 - 5 * DAY, 5 * DAY, step=600)
    spikes = {("a", t0 + 1800), ("b", t0 + 4020)}
    first = online.evaluate(window(points, t0, 3600, spikes=spikes), history, root, "p", 1, OPTIONS, parts=8)
    assert flags(first) == [("a", t0 + 1800)]
    size = store.load_parts(spark, root, "p", "samples")[0].count()
    second = online.evaluate(window(points, t0 + 600, 3600, spikes=spikes), history, root, "p", 2, OPTIONS, parts=8)
    assert flags(second) == [("b", t0 + 4020)]
    # ten more minutes of two series by the minute, without the spike
    assert store.load_parts(spark, root, "p", "samples")[0].count() == size + 19
    again = online.evaluate(window(points, t0 + 600, 3600, spikes=spikes), history, root, "p", 2, OPTIONS, parts=8)
    assert flags(again) == flags(second)
    assert store.load_parts(spark, root, "p", "samples")[0].count() == size + 19


def test_a_batch_rewrites_only_its_parts(spark, points, tmp_path):
    root, t0 = str(tmp_path), 1000 * DAY
    names = [f"s{i}" for i in range(12)]
    online.save_profile(root, "p", window(points, t0 - 2 * DAY, 2 * DAY, names, step=900), OPTIONS, parts=16)
    before = files(f"{root}/p/samples")
    batch = window(points, t0, 3600, names[:1])
    scored = online.score_batch(batch.withColumn("event_id", F.lit(0)), root, "p", OPTIONS, 1, parts=16)
    online.learn_batch(scored, root, "p", OPTIONS, parts=16)
    after = files(f"{root}/p/samples")
    part = store.parts_with(batch, 16)
    assert len(part) == 1
    changed = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {f"part={part[0]}"}
    meta, samples, _ = online.load_profile(spark, root, "p")
    assert meta.count() == 12 and samples.where("series_id = 's0'").agg(F.max("ts")).first()[0] == t0 + 3540
    assert samples.where("series_id <> 's0'").agg(F.max("ts")).first()[0] < t0


def test_alerts_are_replaced_by_run_and_forgotten(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame([(s, t, a) for s, t, a in r], "series_id string, ts long, anomaly int")
    seen = lambda *a: sorted((r.series_id, r.ts) for r in alerts.alerted(spark, root, "k", *a).collect())
    assert seen() == [] and not alerts.has_alerts(spark, root, "k")
    alerts.mark_alerted(root, "k", "x", rows(("a", 5 * DAY, 1), ("a", 9 * DAY, 1), ("b", 9 * DAY + 1, 0)))
    alerts.mark_alerted(root, "k", "y", rows(("a", 9 * DAY, 1), ("b", 7 * DAY, 1)))
    assert seen() == [("a", 5 * DAY), ("a", 9 * DAY), ("b", 7 * DAY)]
    assert seen("y") == [("a", 5 * DAY), ("a", 9 * DAY)]
    newest = spark.createDataFrame([("a", 12 * DAY), ("b", 8 * DAY)], "series_id string, last_seen_ts long")
    assert seen(None, newest, 4 * DAY) == [("a", 9 * DAY), ("b", 7 * DAY)]
    alerts.mark_alerted(root, "k", "x", rows(("a", 9 * DAY + 2, 1)))  # the same run again, with another result
    assert seen() == [("a", 9 * DAY), ("a", 9 * DAY + 2), ("b", 7 * DAY)]
    assert alerts.forget_alerts(spark, root, "k", 8 * DAY) == 2  # the emptied fifth day and the seventh
    assert seen() == [("a", 9 * DAY), ("a", 9 * DAY + 2)]


@pytest.mark.parametrize("mode", ["full", "latest_only"])
def test_a_batch_keeps_to_its_evaluation_window(spark, points, tmp_path, mode):
    root, t0 = str(tmp_path), 1000 * DAY
    options = FunnelOptions(trend="daily", bucket_slot_secs=3_600, alert_output_mode=mode, eval_window_secs=1800)
    online.save_profile(root, "p", window(points, t0 - 3 * DAY, 3 * DAY, step=600), options, parts=4)
    spikes = {("a", t0 + 600), ("a", t0 + 3000), ("a", t0 + 3300)}
    scored = online.score_batch(window(points, t0, 3600, spikes=spikes).withColumn("event_id", F.lit(0)), root, "p", options, parts=4)
    assert flags(scored) == ([("a", t0 + 3000)] if mode == "full" else []) + [("a", t0 + 3300)]
    early = scored.where((F.col("ts") == t0 + 600) & (F.col("series_id") == "a")).first()
    assert early.baseline == 500.0 and early.lower_bound is None and early.verdict is None
