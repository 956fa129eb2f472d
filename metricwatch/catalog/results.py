"""Queries: evaluation, labels, result tables, the older baseline, forecasts and escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricwatch.catalog.dynamics import T0, dynamics_sql, run_dynamics
from metricwatch.catalog.funnel import current, history
from metricwatch.catalog.prepare import calendar_sql, pts
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.catalog.statistics import _STATS, rounded, rounded_sql, stat_ctes
from metricwatch.functions.numeric import q, q_sql
from metricwatch.operators import evaluate
from metricwatch.operators.features import STATISTICS, naive_errors
from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import row_index
from metricwatch.options import ClassifierOptions, DynamicsOptions, ForecastOptions, FunnelOptions, LegacyBaselineOptions
from metricwatch.plans import escalate, forecast, funnel
from metricwatch.plans.dynamics import lookback
from metricwatch.plans.legacy import detect_legacy_baseline
from metricwatch.sources import labels, render

DAY = 86_400
# Label windows made of the data itself: the hour around values above four times the average.
WINDOWS = (
    ("av", "SELECT series_id, avg(value) AS mu FROM pts GROUP BY 1"),
    ("wn", "SELECT series_id, ts - 600 AS start_ts, ts + 600 AS end_ts FROM pts JOIN av USING (series_id) WHERE value > 4 * mu"),
    ("lb", "SELECT p.*, CAST(EXISTS (SELECT 1 FROM wn WHERE wn.series_id = p.series_id AND p.ts BETWEEN start_ts AND end_ts) AS INT) AS label FROM pts p"),
)
FLAGGED = ("fl", "SELECT lb.*, CAST(value > 3 * mu AS INT) AS anomaly FROM lb JOIN av USING (series_id)")


def labelled(spark, folder):
    points = pts(spark, folder)
    means = points.groupBy("series_id").agg(F.avg("value").alias("mu"))
    high = attach(points, means).where(F.col("value") > 4 * F.col("mu"))
    windows = high.select("series_id", (F.col("ts") - 600).alias("start_ts"), (F.col("ts") + 600).alias("end_ts"))
    return labels.label_by_windows(points, windows)


def flagged(spark, folder):
    rows = labelled(spark, folder)
    means = pts(spark, folder).groupBy("series_id").agg(F.avg("value").alias("mu"))
    return attach(rows, means).withColumn("anomaly", (F.col("value") > 3 * F.col("mu")).cast("int")).drop("mu")


@query("label_by_windows", with_ctes("pts", *WINDOWS) + "SELECT series_id, ts, value, label FROM lb")
def label_by_windows(spark, folder):
    return labelled(spark, folder)


@query(
    "label_by_points",
    with_ctes("pts") + "SELECT series_id, ts, CAST(ts % 50 = 0 AS INT) AS label FROM pts",
)
def label_by_points(spark, folder):
    points = pts(spark, folder)
    return labels.label_by_points(points, points.where(F.col("ts") % 50 == 0)).select("series_id", "ts", "label")


_CLUSTERS = (
    ("li", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM lb"),
    ("lg", "SELECT *, rn - lag(rn) OVER (PARTITION BY series_id ORDER BY rn) AS gap FROM li WHERE label = 1"),
    ("lc", "SELECT *, CAST(sum(CASE WHEN gap > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY rn) AS BIGINT) AS cluster FROM lg"),
    ("cl", "SELECT series_id, cluster, min(rn) AS first_rn, max(rn) AS last_rn FROM lc GROUP BY 1, 2"),
)


@query("anomaly_clusters", with_ctes("pts", *WINDOWS, *_CLUSTERS) + "SELECT series_id, cluster, first_rn, last_rn FROM cl")
def anomaly_clusters(spark, folder):
    return labels.anomaly_clusters(row_index(labelled(spark, folder)), 40)


@query(
    "split_around_cluster",
    with_ctes("pts", *WINDOWS, *_CLUSTERS,
              ("mx", "SELECT series_id, least(2, max(cluster)) AS cluster FROM cl GROUP BY 1"),
              ("ch", "SELECT cl.* FROM cl JOIN mx USING (series_id, cluster)"),
              ("bd", "SELECT li.*, CASE WHEN first_rn IS NULL THEN greatest(n - 40, 0) ELSE greatest(first_rn - 20, 0) END AS a, CASE WHEN first_rn IS NULL THEN n ELSE least(last_rn + 21, n) END AS b FROM li LEFT JOIN ch USING (series_id)"))
    + "SELECT series_id, ts, label, CASE WHEN rn < a THEN 'history' ELSE 'current' END AS role FROM bd WHERE rn < b",
)
def split_around_cluster(spark, folder):
    return labels.split_around_cluster(labelled(spark, folder), 40, 2).select("series_id", "ts", "label", "role")


@query(
    "incident_sessions",
    with_ctes("pts", *WINDOWS, FLAGGED,
              ("g", "SELECT *, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM fl WHERE anomaly = 1"),
              ("s", "SELECT *, CAST(sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS BIGINT) AS incident FROM g"))
    + "SELECT series_id, incident, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, max(value) AS peak FROM s GROUP BY 1, 2",
)
def incident_sessions(spark, folder):
    return labels.incidents(flagged(spark, folder), 3_600)


@query(
    "detection_quality",
    with_ctes("pts", *WINDOWS, FLAGGED,
              ("c", "SELECT series_id, count(*) AS n, count_if(anomaly = 1 AND label = 1) AS tp, count_if(anomaly = 1 AND label = 0) AS fp, count_if(anomaly = 0 AND label = 1) AS fn FROM fl GROUP BY 1"),
              ("r", "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c"),
              ("f", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r"))
    + f"SELECT series_id, n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {rounded_sql(['precision', 'recall', 'f1'])}, "
    "f1 >= 0.8 AND recall >= 0.85 AS passed, fp <= 0.05 * n AS clean_passed FROM f",
)
def detection_quality(spark, folder):
    rows = flagged(spark, folder)
    shown = rows.withColumn("shown", render.anomaly_value())
    result = shown.select("series_id", "ts", evaluate.display_to_binary(F.col("shown")).alias("anomaly"))
    found = evaluate.detection_quality(evaluate.align(result, rows))
    return rounded(found, "precision", "recall", "f1", keep=("series_id", "n", "tp", "fp", "fn", "passed", "clean_passed"))


NAIVE = (
    ("hx", f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn FROM pts WHERE ts < {T0}"),
    ("cx", f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn FROM pts WHERE ts >= {T0}"),
    ("ht", "SELECT series_id, avg(abs(d)) AS scale FROM (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY rn) AS d FROM hx) GROUP BY 1"),
    ("nt", "SELECT series_id, avg(abs(d)) AS naive_mae, sqrt(avg(d * d)) AS naive_rmse FROM (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY rn) AS d FROM cx) GROUP BY 1"),
    ("pm", "SELECT series_id, avg(value) AS pred FROM hx GROUP BY 1"),
    ("er", "SELECT series_id, avg(abs(value - pred)) AS mae, sqrt(avg((value - pred) ** 2)) AS rmse FROM cx JOIN pm USING (series_id) GROUP BY 1"),
)


@query(
    "forecast_quality",
    with_ctes("pts", *NAIVE, ("j", "SELECT *, mae / scale AS mase FROM er JOIN ht USING (series_id) JOIN nt USING (series_id)"))
    + f"SELECT series_id, {rounded_sql(['mae', 'rmse', 'mase', 'naive_mae', 'naive_rmse'])}, mase < 1 AND mae <= 0.95 * naive_mae AND rmse <= 0.95 * naive_rmse AS passed FROM j",
)
def forecast_quality(spark, folder):
    """How well does the history's mean predict, against repeating the previous value?"""
    past, now = history(spark, folder), current(spark, folder)
    mean = past.groupBy("series_id").agg(F.avg("value").alias("pred"))
    naive = [evaluate.naive_quality(naive_errors(row_index(p))) for p in (past, now)]
    found = evaluate.forecast_quality(attach(now, mean), *naive)
    return rounded(found, "mae", "rmse", "mase", "naive_mae", "naive_rmse", keep=("series_id", "passed"))


# -- result tables ---------------------------------------------------------------------------

@query(
    "series_names",
    "WITH c AS (SELECT c_custkey, c_name, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nat, c_custkey % 4 AS k FROM customer) "
    "SELECT c_custkey, CASE k WHEN 0 THEN seg || ' of ' || nat || ' and ' WHEN 1 THEN c_name WHEN 2 THEN '{nation=\"' || nat || '\", segment=\"' || seg || '\"}' ELSE '{{segment}}' END AS name, "
    "'A-' || seg || '-Pred' AS col FROM c",
)
def series_names(spark, folder):
    """Templates with labels, a frame name, labels alone, and a template without labels."""
    k = F.col("c_custkey") % 4
    c = spark.read.parquet(f"{folder}/customer.parquet")
    tags = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    tags = F.when(k != 3, tags)
    template = F.when(k == 0, "{{segment}} of {{nation}} and {{unknown}}").when(k == 3, "{{segment}}")
    name = render.series_name(F.when(k == 1, F.col("c_name")), template, tags)
    return c.select("c_custkey", name.alias("name"), render.column_name("A", F.col("c_mktsegment"), "Pred").alias("col"))


BAND_SQL = dynamics_sql("daily", 30, 2.0, 900)


def _dynamics(spark, folder):
    return run_dynamics(spark, folder, DynamicsOptions("daily"))


@query("anomaly_points", f"SELECT series_id, ts, value AS anomaly_value FROM ({BAND_SQL}) WHERE anomaly = 1")
def anomaly_points(spark, folder):
    return render.anomaly_points(_dynamics(spark, folder))


@query(
    "baseline_frame",
    "SELECT series_id, make_timestamp(ts * 1000000) AS time, baseline, lower_bound, upper_bound, "
    f"CASE WHEN anomaly = 1 THEN value END AS anomaly_value FROM ({BAND_SQL})",
)
def baseline_frame(spark, folder):
    return render.result_frame(_dynamics(spark, folder), "baseline").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    "outlier_frame",
    with_ctes("pts", *WINDOWS, FLAGGED) + "SELECT series_id, make_timestamp(ts * 1000000) AS time, CASE WHEN anomaly = 1 THEN value END AS anomaly_value FROM fl",
)
def outlier_frame(spark, folder):
    return render.result_frame(flagged(spark, folder), "outlier").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    "lookback_window",
    with_ctes("pts", ("t0", f"SELECT series_id, min(ts) AS t0 FROM pts WHERE ts >= {T0} GROUP BY 1"))
    + f"SELECT series_id, ts, value FROM pts JOIN t0 USING (series_id) WHERE ts < {T0} AND ts >= t0 - {10 * DAY}",
)
def lookback_window(spark, folder):
    return lookback(history(spark, folder), current(spark, folder), 10)


@query(
    "match_history_by_name",
    with_ctes("pts", ("h", f"SELECT series_id, count(*) AS h FROM pts WHERE ts < {T0} GROUP BY 1"), ("c", f"SELECT series_id, count(*) AS c FROM pts WHERE ts >= {T0} GROUP BY 1"))
    + "SELECT series_id, h AS history_rows, c AS current_rows FROM h JOIN c USING (series_id)",
)
def match_history_by_name(spark, folder):
    counts = [p.groupBy("series_id").agg(F.count(F.lit(1)).alias(n)) for p, n in
              ((history(spark, folder), "history_rows"), (current(spark, folder), "current_rows"))]
    return counts[0].join(counts[1], "series_id")


# -- older baseline --------------------------------------------------------------------------

def legacy_sql(trend: str, interval: int, days: int, k: float = 2) -> str:
    key = {"daily": "0", "weekly": "(ts // 86400 + 3) % 7", "monthly": "day(make_timestamp(ts * 1000000))"}[trend]
    minute = "((ts % 3600) // 60)"
    end = f"CASE WHEN {minute} = 0 THEN {interval} ELSE least(CAST(ceil({minute} / {interval}.0) AS BIGINT) * {interval}, 60) END"
    return with_ctes(
        "pts", ("t0", f"SELECT series_id, min(ts) AS t0 FROM pts WHERE ts >= {T0} GROUP BY 1"),
        ("b", f"SELECT series_id, {key} AS s, (ts % 86400) // 3600 AS hr, avg(value) AS mu, stddev_pop(value) AS sd FROM pts JOIN t0 USING (series_id) "
              f"WHERE ts < {T0} AND ts >= t0 - {days * DAY} GROUP BY 1, 2, 3"),
        ("c", f"SELECT series_id, {key} AS s, (ts % 86400) // 3600 AS hr, {end} AS e, {'ts // 86400' if trend == 'daily' else '0'} AS d, min(ts) AS ts, avg(value) AS value "
              f"FROM pts WHERE ts >= {T0} GROUP BY 1, 2, 3, 4, 5"),
        ("j", f"SELECT c.series_id, ts, value, mu, greatest(mu - {k} * sd, 0.0) AS lower_bound, mu + {k} * sd AS upper_bound FROM c LEFT JOIN b USING (series_id, s, hr)"),
    ) + (f"SELECT series_id, ts, {q_sql('value')} AS value, {q_sql('mu')} AS baseline, {rounded_sql(['upper_bound'])}, "
         f"CASE WHEN mu IS NOT NULL THEN {q_sql('lower_bound')} END AS lower_bound, CAST(coalesce(value < lower_bound OR value > upper_bound, false) AS INT) AS anomaly FROM j")


def _legacy(name: str, options: LegacyBaselineOptions, days: int, k: float = 2) -> None:
    def run(spark, folder):
        found = detect_legacy_baseline(current(spark, folder), history(spark, folder), options)
        return rounded(found, "value", "baseline", "lower_bound", "upper_bound", keep=("series_id", "ts", "anomaly"))

    query(name, legacy_sql(options.trend, options.interval_mins, days, k))(run)


_legacy("legacy_baseline_daily", LegacyBaselineOptions("daily", 15), 30)
_legacy("legacy_baseline_weekly", LegacyBaselineOptions("weekly", 60), 90)
_legacy("legacy_baseline_monthly", LegacyBaselineOptions("monthly", 30), 365)
# 92.5 % lies half way between the multipliers of 90 % (1.64) and 95 % (1.96)
_legacy("legacy_baseline_confidence", LegacyBaselineOptions("weekly", 60, confidence_level=92.5), 90, 1.8)


@query(
    "legacy_baseline_no_trend",
    with_ctes("pts") + f"SELECT series_id, ts, value, CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound, 0 AS anomaly FROM pts WHERE ts >= {T0}",
)
def legacy_baseline_no_trend(spark, folder):
    return detect_legacy_baseline(current(spark, folder), history(spark, folder), LegacyBaselineOptions("none"))


# -- forecast and escalation -----------------------------------------------------------------

_CAL = ("hour_norm", "is_weekend", "dow_sin", "dom_cos")


@query(
    "forecast_features",
    with_ctes("pts", *NAIVE[:1], *stat_ctes("hx", (1, 24))) + f"SELECT series_id, ts, {rounded_sql(_STATS)}, "
    + ", ".join(f"{q_sql(calendar_sql()[c])} AS {c}" for c in _CAL) + " FROM st",
)
def forecast_features(spark, folder):
    found = forecast.forecast_features(history(spark, folder), (1, 24))
    return rounded(found, *STATISTICS, "lag_1", "lag_24", *_CAL, keep=("series_id", "ts"))


@query(
    "forecast_bands",
    with_ctes("pts", *NAIVE,
              ("rs", "SELECT series_id, stddev_samp(value - pred) AS sd FROM hx JOIN pm USING (series_id) GROUP BY 1"),
              ("b", "SELECT cx.series_id, ts, value, pred AS baseline, greatest(pred - 2 * sd, 0.0) AS lower_bound, pred + 2 * sd AS upper_bound FROM cx JOIN pm USING (series_id) JOIN rs USING (series_id)"))
    + f"SELECT series_id, ts, value, {rounded_sql(['baseline', 'lower_bound', 'upper_bound'])}, CAST(value < lower_bound OR value > upper_bound AS INT) AS anomaly FROM b",
)
def forecast_bands(spark, folder):
    """Residual spread on the training window, bands and flags, here around the history's mean."""
    fit = history(spark, folder).groupBy("series_id").agg(F.avg("value").alias("pred"), F.stddev_samp("value").alias("residual_std"))
    found = forecast.forecast_bands(attach(current(spark, folder), fit))
    return rounded(found, "baseline", "lower_bound", "upper_bound", keep=("series_id", "ts", "value", "anomaly"))


@query("forecast_detector")
def forecast_detector(spark, folder):
    return forecast.detect_forecast(current(spark, folder), history(spark, folder), ForecastOptions(periods=(24,)))


@query("routing_decisions")
def routing_decisions(spark, folder):
    return escalate.decisions(history(spark, folder), ClassifierOptions()).select("series_id", "kind", "decision.*")


@query("funnel_two_levels")
def funnel_two_levels(spark, folder):
    options = FunnelOptions(trend="daily", bucket_slot_secs=3_600, enable_l2=True)
    return funnel.detect_funnel(current(spark, folder), history(spark, folder), options)


@query(
    "merge_levels",
    with_ctes("pts", ("v", f"SELECT series_id, ts, ['normal', 'anomaly', 'uncertain'][ts % 3 + 1] AS verdict, value FROM pts WHERE ts >= {T0}"))
    + "SELECT series_id, ts, verdict, CASE WHEN verdict = 'anomaly' THEN 1 WHEN verdict = 'uncertain' AND ts % 2 = 0 THEN 1 ELSE 0 END AS anomaly, "
    "CASE WHEN verdict = 'uncertain' AND ts % 2 = 0 THEN value + 1 ELSE value END AS baseline FROM v",
)
def merge_levels(spark, folder):
    kinds = F.array(*[F.lit(v) for v in ("normal", "anomaly", "uncertain")])
    now = current(spark, folder)
    l1 = now.select("series_id", "ts", F.element_at(kinds, (F.col("ts") % 3 + 1).cast("int")).alias("verdict"),
                    F.col("value").alias("baseline"), F.col("value").alias("lower_bound"), F.col("value").alias("upper_bound"))
    l2 = now.where(F.col("ts") % 2 == 0).select(
        "series_id", "ts", (F.col("value") + 1).alias("l2_baseline"), F.lit(None).cast("double").alias("l2_lower"),
        F.lit(None).cast("double").alias("l2_upper"), F.lit(1).alias("l2_anomaly"))
    return funnel.merge_levels(l1, l2).select("series_id", "ts", "verdict", "anomaly", "baseline")
