"""Files, labels, names, stored tables and streams."""

from pyspark.sql import functions as F

from metricwatch.options import FunnelOptions
from metricwatch.plans import funnel, profile
from metricwatch.sources import labels, render, store
from metricwatch.streaming import online


def test_labelled_and_raw_csv(spark, tmp_path):
    (tmp_path / "cpu.csv").write_text("timestamp_ms,value,is_anomaly\n1000,1.5,0\n2000,2.5,1\n3000,3.5,0.7\n")
    (tmp_path / "raw.csv").write_text("timestamp,value\n2014-04-10 07:15:00,3\nbroken,4\n2014-04-10 07:20:00,x\n")
    got = labels.read_labelled_csv(spark, str(tmp_path / "cpu.csv")).orderBy("ts").collect()
    assert [tuple(r) for r in got] == [("cpu", 1, 1.5, 0), ("cpu", 2, 2.5, 1), ("cpu", 3, 3.5, 1)]
    assert [tuple(r) for r in labels.read_raw_csv(spark, str(tmp_path / "raw.csv")).collect()] == [("raw", 1397114100, 3.0)]


def test_windows_are_closed_and_may_span_days(spark, points):
    p = points([("s", t, 0) for t in (0, 10, 86_400, 200_000, 200_001)])
    windows = spark.createDataFrame([("s", 10, 200_000), ("s", 5, 12)], "series_id string, start_ts long, end_ts long")
    got = {r["ts"]: r["label"] for r in labels.label_by_windows(p, windows).collect()}
    assert got == {0: 0, 10: 1, 86_400: 1, 200_000: 1, 200_001: 0}


def test_split_without_anomalies_takes_the_tail(points):
    rows = points([("s", i, i) for i in range(10)]).withColumn("label", F.lit(0))
    got = [r["role"] for r in labels.split_around_cluster(rows, 4).orderBy("ts").collect()]
    assert got == ["history"] * 6 + ["current"] * 4


def test_label_templates(spark):
    tags = F.create_map(F.lit("b"), F.lit("{{a}}"), F.lit("a"), F.lit("1"))
    empty = F.create_map().cast("map<string,string>")
    r = spark.range(1).select(
        render.interpolate_label(F.lit("x {{b}}-{{a}}{{zz}} {{open"), tags), render.label_name(tags),
        render.interpolate_label(F.lit("{{a}}"), empty), render.label_name(empty),
    ).first()
    assert tuple(r) == ("x {{a}}-1 {{open", '{a="1", b="{{a}}"}', "{{a}}", "")


def test_versions_survive_and_old_ones_go(spark, tmp_path, points):
    root = str(tmp_path)
    assert store.load_tables(spark, root, "k", "t") is None
    for i in range(5):
        store.save_tables(root, "k", t=points([("s", i, i)]))
    assert store.load_tables(spark, root, "k", "t")[0].first()["ts"] == 4
    assert sorted(p.name for p in (tmp_path / "k").iterdir()) == ["v=2", "v=3", "v=4"]
    assert store.delete_tables(spark, root, "k") and store.load_tables(spark, root, "k", "t") is None


def test_stream_equals_batch_and_learns_once(spark, tmp_path, points):
    options = FunnelOptions(trend="daily", bucket_slot_secs=3_600)
    history = points([("s", d * 86_400 + m * 600, 100 + m % 7) for d in range(10) for m in range(144)])
    batch = points([("s", 10 * 86_400 + m * 600, 900 if m == 30 else 103) for m in range(60)]).withColumn("event_id", F.col("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "store")
    online.save_profile(root, "p", history, options)
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        online.run_online(stream, root, "p", str(tmp_path / "out"), str(tmp_path / "state"), options).awaitTermination()
    got = {r["ts"]: (r["anomaly"], round(r["upper_bound"], 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["ts"]: (r["anomaly"], round(r["upper_bound"], 6)) for r in funnel.detect_funnel(batch.drop("event_id"), history, options).collect()}
    assert got == want and sum(a for a, _ in got.values()) == 1
    meta, samples = store.load_parts(spark, root, "p", "meta", "samples")
    assert meta.first()["last_seen_ts"] == 10 * 86_400 + 59 * 600
    assert samples.where(F.col("ts") >= 10 * 86_400).count() == 59  # all but the anomaly
    again = profile.refresh_profile(meta, samples, batch.drop("event_id"), batch.where("value = 900"), options)[1]
    assert again.count() == samples.count()
