"""Queries: the streaming operators, run to the end of the events table.

Results go to files in the session's checkpoint folder and are read back from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.catalog.dynamics import T0
from metricwatch.catalog.funnel import BANDS, DAILY, DAY, HIST, SAMPLES, current, history, l1_ctes, purge_ctes
from metricwatch.catalog.prepare import key_sql
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.catalog.statistics import rounded, rounded_sql
from metricwatch.functions.numeric import q, q_sql
from metricwatch.operators import forest
from metricwatch.operators.ordered import row_index
from metricwatch.options import FunnelOptions, OutlierOptions
from metricwatch.session import checkpoint_dir, cut_lineage, delete_at_end
from metricwatch.sources import alerts
from metricwatch.sources.points import read_events
from metricwatch.sources.store import load_parts, load_tables, model_key, save_tables
from metricwatch.streaming import online, points

LATE = 600


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over everything there is and return what it wrote."""
    base = scratch(stream.sparkSession)
    run = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def drain_closed(source: DataFrame, shape, at: int, **mark) -> DataFrame:
    """Run `shape(source)`, say that the source ends at second `at`, run on from the same state, and return all that came out."""
    spark = source.sparkSession
    base = scratch(spark)
    delete_at_end(spark, f"{base}/marks")
    stream = shape(points.with_end_marks(source, f"{base}/marks"))
    for closing in (False, True):
        if closing:
            points.mark_end(source, f"{base}/marks", at, **mark)
        (
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def last_second(spark, folder) -> int:
    return read_events(spark, folder).agg(F.max(F.floor(F.col("ts").cast("double")))).first()[0]


def flagged_stream(spark, folder):
    return points.stream_events(spark, folder).withColumn("anomaly", (F.col("value") > 40).cast("int"))


@query(
    "stream_resample",
    with_ctes("raw", ("m", "SELECT max(ts) AS top FROM raw"))
    + f"SELECT series_id, ts // 3600 * 3600 AS ts, {q_sql('avg(value)')} AS value, max(value) AS peak, count(*) AS points FROM raw, m "
    f"WHERE ts // 3600 * 3600 + 3600 <= top - {LATE} GROUP BY 1, 2",
)
def stream_resample(spark, folder):
    found = drain(points.resample_stream(points.stream_events(spark, folder), 3_600, LATE))
    return found.withColumn("value", q("value"))


@query(
    "stream_sliding_windows",
    with_ctes("raw", ("m", "SELECT max(ts) AS top FROM raw"), ("w", "SELECT series_id, value, top, unnest([0, 1, 2, 3]) AS i, ts // 900 * 900 - i * 900 AS s FROM raw, m"))
    + f"SELECT series_id, s AS ts, max(value) AS peak, count(*) AS points FROM w WHERE s + 3600 <= top - {LATE} GROUP BY 1, 2",
)
def stream_sliding_windows(spark, folder):
    found = drain(points.resample_stream(points.stream_events(spark, folder), 3_600, LATE, 900))
    return found.select("series_id", "ts", "peak", "points")


@query("stream_deduplicate", with_ctes("raw") + "SELECT DISTINCT series_id, ts FROM raw")
def stream_deduplicate(spark, folder):
    return drain(points.first_of_each_second(points.stream_events(spark, folder), LATE)).select("series_id", "ts")


@query("stream_new_alerts", with_ctes("raw") + "SELECT DISTINCT series_id, ts FROM raw WHERE value > 40")
def stream_new_alerts(spark, folder):
    return drain(points.new_alerts(flagged_stream(spark, folder), 86_400)).select("series_id", "ts")


INCIDENTS = (
    ("f", "SELECT *, max(ts) OVER () AS top FROM raw WHERE value > 40"),
    ("g", "SELECT *, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM f"),
    ("s", "SELECT *, sum(CASE WHEN gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS k FROM g"),
    ("z", "SELECT series_id, k, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, max(value) AS peak, any_value(top) AS top FROM s GROUP BY 1, 2"),
)


@query(
    "stream_incidents",
    with_ctes("raw", *INCIDENTS) + f"SELECT series_id, start_ts, end_ts, points, peak FROM z WHERE end_ts + 3600 <= top - {LATE}",
)
def stream_incidents(spark, folder):
    return drain(points.incident_stream(flagged_stream(spark, folder), 3_600, LATE))


@query(
    "stream_resample_closed",
    with_ctes("raw") + f"SELECT series_id, ts // 3600 * 3600 AS ts, {q_sql('avg(value)')} AS value, max(value) AS peak, count(*) AS points FROM raw GROUP BY 1, 2",
)
def stream_resample_closed(spark, folder):
    """All windows, those that were still open at the end as well."""
    at = last_second(spark, folder) + 3_600 + LATE + 1
    found = drain_closed(points.stream_events(spark, folder), lambda s: points.resample_stream(s, 3_600, LATE), at)
    return found.withColumn("value", q("value"))


@query("stream_canonical", with_ctes("pts") + "SELECT series_id, ts, value FROM pts")
def stream_canonical(spark, folder):
    """Each second once, with the value of its largest event."""
    return drain_closed(points.stream_events(spark, folder), lambda s: points.canonical_stream(s, LATE), last_second(spark, folder) + LATE + 2)


@query(
    "stream_incidents_closed",
    with_ctes("raw", *INCIDENTS) + "SELECT series_id, start_ts, end_ts, points, peak FROM z",
)
def stream_incidents_closed(spark, folder):
    """All incidents, those that were still open at the end as well."""
    at = last_second(spark, folder) + 3_600 + LATE + 1
    return drain_closed(flagged_stream(spark, folder), lambda s: points.incident_stream(s, 3_600, LATE), at, anomaly=1)


def _current_stream(spark, folder):
    return points.stream_events(spark, folder).where(F.col("ts") >= T0)


@query(
    "stream_l1_scoring",
    with_ctes("pts", *l1_ctes()) + f"SELECT series_id, ts, value, verdict, {rounded_sql(BANDS)} FROM lv",
)
def stream_l1_scoring(spark, folder):
    """Scoring a stream against a stored profile equals the batch filter."""
    base = scratch(spark)
    online.save_profile(f"{base}/store", "profile", history(spark, folder), DAILY)
    run = online.run_online(_current_stream(spark, folder), f"{base}/store", "profile", f"{base}/out", f"{base}/state", DAILY, learn=False)
    run.awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"), *BANDS, keep=("series_id", "ts", "value", "verdict"))


# The stream's points with their flags under the bands of the history, and what the profile then holds.
UPKEEP = (
    ("fl", "SELECT series_id, ts, value, coalesce(value < lower_bound OR value > upper_bound, false) AS bad FROM lv"),
    ("ls", "SELECT series_id, max(ts) AS last FROM pts GROUP BY 1"),
    ("un", f"SELECT series_id, bucket, ts, value FROM kept UNION ALL SELECT series_id, CAST({key_sql('daily', 3600)} AS INT), ts, value FROM fl WHERE NOT bad"),
    ("ub", f"SELECT un.* FROM un JOIN ls USING (series_id) WHERE ts >= last - {DAILY.lookback_secs}"),
    *purge_ctes("ub", 3.5, 5, 12, "learned"),
)


@query(
    "stream_profile_upkeep",
    with_ctes("pts", *l1_ctes(), *UPKEEP) + "SELECT series_id, bucket, ts, value FROM learned",
)
def stream_profile_upkeep(spark, folder):
    """The profile after the stream has been scored and learned."""
    base = scratch(spark)
    online.save_profile(f"{base}/store", "profile", history(spark, folder), DAILY)
    run = online.run_online(_current_stream(spark, folder), f"{base}/store", "profile", f"{base}/out", f"{base}/state", DAILY)
    run.awaitTermination()
    return load_parts(spark, f"{base}/store", "profile", "samples")[0]


TWO_RUNS = FunnelOptions(trend="daily", bucket_slot_secs=3_600, eval_window_secs=10 * DAY, alert_output_mode="dedupe")


@query(
    "funnel_dedupe_two_runs",
    with_ctes("pts", *l1_ctes())
    + f"SELECT series_id, ts, value, verdict, CASE WHEN ts >= {T0 + 3 * DAY} AND (value < lower_bound OR value > upper_bound) THEN 1 ELSE 0 END AS anomaly "
    f"FROM lv WHERE ts >= {T0 + DAY} AND ts < {T0 + 5 * DAY}",
)
def funnel_dedupe_two_runs(spark, folder):
    """The second of two overlapping evaluations raises only what the first has not; run again, it raises the same."""
    base, now = scratch(spark), current(spark, folder)
    online.save_profile(base, "profile", history(spark, folder), TWO_RUNS)
    for run, start, end in (("first", 0, 3), ("second", 1, 5), ("second", 1, 5)):
        window = now.where((F.col("ts") >= T0 + start * DAY) & (F.col("ts") < T0 + end * DAY)).withColumn("event_id", F.lit(0))
        scored = cut_lineage(online.score_batch(window, base, "profile", TWO_RUNS, run))
        alerts.mark_alerted(base, "profile", run, scored)
    return scored.select("series_id", "ts", "value", "verdict", "anomaly")


@query("stored_profile", with_ctes("pts", HIST, SAMPLES, *purge_ctes("b", 3.5, 5, 10, "kept")) + "SELECT series_id, bucket, ts, value FROM kept")
def stored_profile(spark, folder):
    """A profile as it comes back from its table."""
    base = scratch(spark)
    online.save_profile(base, "profile", history(spark, folder), DAILY)
    return load_parts(spark, base, "profile", "samples")[0]


@query("stored_forest_scores")
def stored_forest_scores(spark, folder):
    """Later points scored with a forest trained on earlier ones and saved."""
    base, options = scratch(spark), OutlierOptions()
    scaling, nodes = forest.fit_forest(row_index(history(spark, folder)), options)
    key = model_key(options)
    save_tables(base, key, scaling=scaling, forest=nodes)
    return forest.forest_scores(row_index(current(spark, folder)), options, load_tables(spark, base, key, "scaling", "forest"))
