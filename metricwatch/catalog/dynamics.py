"""Queries: seasonal mean bands on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricwatch.catalog.registry import query, with_ctes
from metricwatch.functions.numeric import q, q_sql
from metricwatch.options import DynamicsOptions
from metricwatch.plans import dynamics
from metricwatch.sources.points import read_events

T0 = 1_706_054_400  # 2024-01-24
T0_TEXT = "2024-01-24 00:00:00"
# SQL text of the bucket numbers (hour slots).
KEY_SQL = {
    "daily": "(ts % 86400) // 3600",
    "weekly": "((ts // 86400 + 3) % 7) * 24 + (ts % 86400) // 3600",
    "monthly": "(day(to_timestamp(ts) AT TIME ZONE 'UTC') - 1) * 24 + (ts % 86400) // 3600",
    "none": "0",
}
COUNT = {"daily": 24, "weekly": 168, "monthly": 744, "none": 1}


def dynamics_sql(trend: str, days: int, k: float, transition: int) -> str:
    t = 0 if trend == "none" else min(transition, 1800)
    s = "CAST(c.ts % 3600 AS DOUBLE)"
    wp = f"CASE WHEN {t} > 0 AND {s} < {t} THEN 0.5 - 0.5 * {s} / {max(t, 1)}.0 ELSE 0.0 END"
    wn = (
        f"CASE WHEN {t} > 0 AND {s} >= {t} AND {s} > 3600 - {t} "
        f"THEN 0.5 * (({s} - (3600 - {t})) / {max(t, 1)}.0) ELSE 0.0 END"
    )
    return with_ctes(
        "raw",
        ("cur", f"SELECT *, {KEY_SQL[trend]} AS k FROM raw WHERE ts >= {T0}"),
        ("t0", "SELECT series_id, min(ts) AS t0 FROM cur GROUP BY 1"),
        ("hist", f"SELECT r.*, {KEY_SQL[trend]} AS k FROM raw r JOIN t0 USING (series_id) "
                 f"WHERE r.ts < {T0} AND ts >= t0 - {days * 86400} AND ts < t0"),
        ("b", "SELECT series_id, k, avg(value) AS mu, stddev_pop(value) AS sd FROM hist GROUP BY 1, 2"),
        ("j", f"SELECT c.series_id, c.ts, c.value, b.mu, b.sd, p.mu AS pmu, p.sd AS psd, "
              f"x.mu AS nmu, x.sd AS nsd, {wp} AS wp0, {wn} AS wn0 FROM cur c "
              f"LEFT JOIN b ON b.series_id = c.series_id AND b.k = c.k "
              f"LEFT JOIN b p ON p.series_id = c.series_id AND p.k = (c.k + {COUNT[trend] - 1}) % {COUNT[trend]} "
              f"LEFT JOIN b x ON x.series_id = c.series_id AND x.k = (c.k + 1) % {COUNT[trend]}"),
        ("w", "SELECT *, CASE WHEN pmu IS NULL THEN 0.0 ELSE wp0 END AS wp, "
              "CASE WHEN nmu IS NULL THEN 0.0 ELSE wn0 END AS wn FROM j"),
        ("m", "SELECT series_id, ts, value, "
              "wp * coalesce(pmu, mu) + (1 - wp - wn) * mu + wn * coalesce(nmu, mu) AS baseline, "
              "wp * coalesce(psd, sd) + (1 - wp - wn) * sd + wn * coalesce(nsd, sd) AS sd FROM w"),
        ("d", f"SELECT series_id, ts, value, baseline, CASE WHEN baseline IS NOT NULL THEN "
              f"greatest(baseline - {k} * sd, 0.0) END AS lower_bound, baseline + {k} * sd AS upper_bound FROM m"),
    ) + (
        f"SELECT series_id, ts, value, {q_sql('baseline')} AS baseline, {q_sql('lower_bound')} AS lower_bound, "
        f"{q_sql('upper_bound')} AS upper_bound, "
        "CAST(coalesce(value < lower_bound OR value > upper_bound, false) AS INT) AS anomaly FROM d"
    )


def run_dynamics(spark, folder, options: DynamicsOptions):
    current = read_events(spark, folder, start=T0_TEXT)
    history = read_events(spark, folder, end=T0_TEXT)
    found = dynamics.detect_dynamics(current, history, options)
    return found.select(
        "series_id", "ts", "value", q("baseline").alias("baseline"),
        q("lower_bound").alias("lower_bound"), q("upper_bound").alias("upper_bound"), "anomaly",
    )


def _register(name: str, options: DynamicsOptions) -> None:
    sql = dynamics_sql(options.trend, options.lookback_days, options.std_dev_multiplier, options.transition_secs)
    query(name, sql)(lambda spark, folder: run_dynamics(spark, folder, options))


_register("dynamics_daily", DynamicsOptions("daily"))
_register("dynamics_weekly", DynamicsOptions("weekly"))
_register("dynamics_monthly", DynamicsOptions("monthly", std_dev_multiplier=1.5))
_register("dynamics_no_trend", DynamicsOptions("none", period_days=14))
_register("dynamics_stairs", DynamicsOptions("daily", transition_minutes=0))
