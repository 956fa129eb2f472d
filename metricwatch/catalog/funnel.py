"""Queries: profiles and the first funnel level."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from metricwatch.catalog.dynamics import T0
from metricwatch.catalog.prepare import _SNAP, key_sql, pts
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.catalog.statistics import MATE_CTES, effect_sql, hampel_ctes, mad_ctes, rounded, rounded_sql
from metricwatch.functions import season
from metricwatch.functions.numeric import q_sql
from metricwatch.operators.robust_buckets import bucket_stats
from metricwatch.options import FunnelOptions
from metricwatch.plans import funnel, profile
from metricwatch.sources.points import canonical, read_events

DAY = 86_400
HIST = ("h", f"SELECT * FROM pts WHERE ts < {T0}")
CUR = ("c", f"SELECT * FROM pts WHERE ts >= {T0}")
DAILY = FunnelOptions(trend="daily", bucket_slot_secs=3_600)


# T0 as a literal of the stored column, so that the time bound reaches the scan.
BOUNDARY = datetime.fromtimestamp(T0, UTC).strftime("%Y-%m-%d %H:%M:%S")


def history(spark, folder):
    return canonical(read_events(spark, folder, end=BOUNDARY))


def current(spark, folder):
    return canonical(read_events(spark, folder, start=BOUNDARY))


@query(
    "infer_trend",
    with_ctes(
        "raw", ("pts", f"SELECT series_id, ts // 3600 * 3600 AS ts, max(value) AS value FROM raw WHERE ts < {T0} GROUP BY 1, 2"),
        *effect_sql("(ts % 86400) // 3600", "hour_effect"), *effect_sql("(ts // 86400 + 3) % 7", "weekday_effect"), *MATE_CTES,
        ("sp", "SELECT series_id, (max(ts) - min(ts)) / 86400.0 AS span_days FROM pts GROUP BY 1"),
        ("j", "SELECT * FROM sp JOIN hour_effect USING (series_id) JOIN weekday_effect USING (series_id) JOIN mate USING (series_id)"),
    )
    + f"SELECT series_id, {rounded_sql(['span_days', 'hour_effect', 'weekday_effect', 'day_strength'])}, "
    "CASE WHEN span_days < 2 THEN 'none' WHEN hour_effect < 0.05 AND weekday_effect < 0.05 AND day_strength < 0.05 THEN 'none' "
    "WHEN span_days >= 14 AND weekday_effect > greatest(hour_effect, 0.08) AND weekday_effect > 0.1 THEN 'weekly' "
    "WHEN span_days >= 180 AND day_strength > 0.2 AND weekday_effect > hour_effect THEN 'monthly' "
    "WHEN hour_effect >= 0.05 OR day_strength >= 0.05 THEN 'daily' WHEN span_days >= 14 THEN 'weekly' ELSE 'daily' END AS trend FROM j",
)
def infer_trend(spark, folder):
    from metricwatch.operators.prepare import resample

    hourly = resample(read_events(spark, folder, end="2024-01-24 00:00:00"), 3_600, "max")
    return rounded(profile.infer_trends(hourly), "span_days", "hour_effect", "weekday_effect", "day_strength", keep=("series_id", "trend"))


def _attempt_union() -> str:
    out = []
    for t, trend in enumerate(season.TRENDS):
        for s, slot in enumerate(season.SLOTS):
            days = {"daily": 1, "weekly": 7, "monthly": 31}.get(trend)
            count = days * DAY // slot if days else 1
            out.append(
                f"SELECT series_id, {t * 6 + s} AS rank, '{trend}' AS effective_trend, {slot} AS slot_secs, "
                f"1.0 - count_if(n >= 5) / {count}.0 AS sparse_ratio FROM (SELECT series_id, {key_sql(trend, slot)} AS k, count(*) AS n "
                f"FROM h JOIN want USING (series_id) WHERE {slot} {'=' if trend == 'none' else '>='} slot GROUP BY 1, 2) GROUP BY 1"
            )
    return " UNION ALL ".join(out)


@query(
    "choose_profile_buckets",
    with_ctes(
        "pts", HIST,
        ("g", "SELECT series_id, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM h"),
        ("gr", "SELECT series_id, gap, row_number() OVER (PARTITION BY series_id ORDER BY gap) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM g WHERE gap > 0"),
        ("want", f"SELECT series_id, {_SNAP.format(x='gap')} AS slot FROM gr WHERE r = n // 2 + 1"),
        ("tries", _attempt_union()),
        ("ok", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rank) AS r FROM tries WHERE sparse_ratio <= 0.3 OR effective_trend = 'none'"),
    )
    + f"SELECT series_id, 'monthly' AS trend, effective_trend, CAST(slot_secs AS INT) AS slot_secs, {q_sql('sparse_ratio')} AS sparse_ratio FROM ok WHERE r = 1",
)
def choose_profile_buckets(spark, folder):
    """Start at monthly buckets and the inferred slot; coarsen until few buckets are sparse."""
    points = history(spark, folder)
    options = FunnelOptions(trend="monthly")
    meta = profile.choose_buckets(points, profile.wanted_buckets(points, options), options)
    return rounded(meta, "sparse_ratio", keep=("series_id", "trend", "effective_trend", "slot_secs"))


SAMPLES = ("b", f"SELECT series_id, CAST({key_sql('daily', 3600)} AS INT) AS bucket, ts, value FROM h")


def purge_ctes(src: str, k: float, min_samples: int, rounds: int, out: str) -> tuple:
    """`rounds` scrubbing rounds spelled out; they stop changing anything well before the last."""
    steps, here = [], src
    for i in range(rounds):
        m, r = f"{out}_m{i}", out if i == rounds - 1 else f"{out}_{i}"
        steps += [
            (f"{m}a", f"SELECT series_id, bucket, median(value) AS med, count(*) AS n FROM {here} GROUP BY 1, 2"),
            (f"{m}b", f"SELECT x.*, med, n, abs(value - med) AS dev FROM {here} x JOIN {m}a USING (series_id, bucket)"),
            (f"{m}c", f"SELECT series_id, bucket, greatest(median(dev) * 1.4826, abs(any_value(med)) * 0.005, 1e-9) AS scale FROM {m}b GROUP BY 1, 2"),
            (f"{m}d", f"SELECT x.*, dev <= {k} * scale AS inlier FROM {m}b x JOIN {m}c USING (series_id, bucket)"),
            (f"{m}e", f"SELECT *, count_if(inlier) OVER (PARTITION BY series_id, bucket) AS inliers FROM {m}d"),
            (r, f"SELECT series_id, bucket, ts, value FROM {m}e WHERE n <= {min_samples} OR inliers < {min_samples} OR inlier"),
        ]
        here = r
    return tuple((n, f"{t}") for n, t in steps)


@query(
    "purge_bucket_outliers",
    with_ctes("pts", HIST, SAMPLES, *purge_ctes("b", 3.5, 5, 10, "kept")) + "SELECT series_id, bucket, ts, value FROM kept",
)
def purge_bucket_outliers(spark, folder):
    points = history(spark, folder)
    samples = points.withColumn("bucket", season.season_key(F.col("ts"), "daily")).select(*profile.SAMPLES)
    return profile.purge(samples, DAILY)


@query(
    "profile_bucket_stats",
    with_ctes("pts", HIST, SAMPLES, *hampel_ctes("b", "series_id, bucket", 3.5, "r"),
              ("m", "SELECT series_id, bucket, count(*) AS count, avg(value) AS mean, stddev_pop(value) AS std FROM b GROUP BY 1, 2"))
    + f"SELECT series_id, bucket, count, {rounded_sql(['median', 'scale', 'mean', 'std'])} FROM m JOIN r USING (series_id, bucket)",
)
def profile_bucket_stats(spark, folder):
    samples = history(spark, folder).withColumn("bucket", season.season_key(F.col("ts"), "daily"))
    stats = bucket_stats(samples, 3.5, 5)
    return rounded(stats, "median", "scale", "mean", "std", keep=("series_id", "bucket", "count"))


def l1_ctes(k_outer=2.5, k_inner=1.5, min_samples=5, rounds=10) -> tuple:
    s = "CAST(c.ts % 3600 AS DOUBLE)"
    wp = f"CASE WHEN {s} < 900 THEN 0.5 - 0.5 * {s} / 900.0 ELSE 0.0 END"
    wn = f"CASE WHEN {s} >= 900 AND {s} > 2700 THEN 0.5 * (({s} - 2700) / 900.0) ELSE 0.0 END"

    def mix(name: str) -> str:
        wp_, wn_ = f"(CASE WHEN p_{name} IS NULL THEN 0 ELSE wp END)", f"(CASE WHEN n_{name} IS NULL THEN 0 ELSE wn END)"
        return f"{wp_} * coalesce(p_{name}, {name}) + (1 - {wp_} - {wn_}) * {name} + {wn_} * coalesce(n_{name}, {name})"

    cols = ("median", "scale", "mean", "std")
    pick = ", ".join(f"b0.{x}, p.{x} AS p_{x}, x.{x} AS n_{x}" for x in cols)
    return (
        HIST, CUR, SAMPLES, *purge_ctes("b", 3.5, min_samples, rounds, "kept"),
        *hampel_ctes("kept", "series_id, bucket", 3.5, "rb"),
        ("mb", "SELECT series_id, bucket, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM kept GROUP BY 1, 2"),
        ("bs", f"SELECT series_id, bucket, median, scale, mean, std FROM mb JOIN rb USING (series_id, bucket) WHERE mb.n >= {min_samples}"),
        ("mu", "SELECT series_id, avg(value) AS mu FROM h GROUP BY 1"),
        ("sk", "SELECT series_id, avg((value - mu) ** 3) / avg((value - mu) ** 2) ** 1.5 AS skew FROM h JOIN mu USING (series_id) GROUP BY 1"),
        ("me", "SELECT series_id, CASE WHEN abs(skew) < 0.5 THEN 'mad' WHEN abs(skew) < 1.0 THEN 'iqr' ELSE 'zscore' END AS method FROM sk"),
        ("cj", f"SELECT c.series_id, c.ts, c.value, {wp} AS wp, {wn} AS wn, method, {pick} FROM c LEFT JOIN me USING (series_id) "
               "LEFT JOIN bs b0 ON b0.series_id = c.series_id AND b0.bucket = (c.ts % 86400) // 3600 "
               "LEFT JOIN bs p ON p.series_id = c.series_id AND p.bucket = ((c.ts % 86400) // 3600 + 23) % 24 "
               "LEFT JOIN bs x ON x.series_id = c.series_id AND x.bucket = ((c.ts % 86400) // 3600 + 1) % 24"),
        ("cb", f"SELECT *, CASE WHEN median IS NOT NULL THEN {mix('median')} ELSE {mix('mean')} END AS baseline, "
               f"(CASE WHEN median IS NOT NULL THEN {mix('scale')} ELSE ({mix('std')}) * CASE WHEN method = 'mad' THEN 1.4826 ELSE 1.0 END END) "
               "* CASE WHEN method = 'iqr' THEN 1.5 ELSE 1.0 END AS reach FROM cj"),
        ("l1", f"SELECT series_id, ts, value, baseline, baseline - {k_outer} * reach AS lower_bound, baseline + {k_outer} * reach AS upper_bound, "
               f"baseline - {k_inner} * reach AS inner_lower, baseline + {k_inner} * reach AS inner_upper FROM cb"),
        ("lv", "SELECT *, CASE WHEN baseline IS NULL THEN 'uncertain' WHEN value < lower_bound OR value > upper_bound THEN 'anomaly' "
               "WHEN value >= inner_lower AND value <= inner_upper THEN 'normal' ELSE 'uncertain' END AS verdict FROM l1"),
    )


BANDS = ["baseline", "lower_bound", "upper_bound", "inner_lower", "inner_upper"]


def run_l1(spark, folder, options=DAILY):
    past, now = history(spark, folder), current(spark, folder)
    meta, samples = profile.build_profile(past, options)
    return funnel.l1_filter(now, meta, funnel.l1_buckets(meta, samples, options), funnel.l1_methods(past), options)


@query(
    "l1_filter",
    with_ctes("pts", *l1_ctes()) + f"SELECT series_id, ts, value, verdict, {rounded_sql(BANDS)} FROM lv",
)
def l1_filter(spark, folder):
    return rounded(run_l1(spark, folder), *BANDS, keep=("series_id", "ts", "value", "verdict"))


@query(
    "l1_metrics",
    with_ctes("pts", *l1_ctes(),
              ("t", "SELECT series_id, count(*) AS total, count_if(verdict = 'normal') AS l1_normal, count_if(verdict = 'anomaly') AS l1_anomaly, "
                    "count_if(verdict = 'uncertain') AS l1_uncertain FROM lv GROUP BY 1"))
    + f"SELECT series_id, total, CAST(l1_normal AS BIGINT) AS l1_normal, CAST(l1_anomaly AS BIGINT) AS l1_anomaly, CAST(l1_uncertain AS BIGINT) AS l1_uncertain, "
    f"{q_sql('(l1_normal + l1_anomaly) / total')} AS coverage, {q_sql('l1_uncertain / total')} AS escalation FROM t",
)
def l1_metrics(spark, folder):
    found = funnel.l1_metrics(run_l1(spark, folder))
    return rounded(found, "coverage", "escalation", keep=("series_id", "total", "l1_normal", "l1_anomaly", "l1_uncertain"))


RESULT = ["baseline", "lower_bound", "upper_bound"]


def _funnel_sql(window: int, mode: str) -> str:
    shown = (
        ("e", f"SELECT *, ts >= max(ts) OVER (PARTITION BY series_id) - {window} AS in_eval FROM l1"),
        ("s", "SELECT series_id, ts, value, CASE WHEN in_eval THEN baseline ELSE value END AS baseline, CASE WHEN in_eval THEN lower_bound END AS lower_bound, "
              "CASE WHEN in_eval THEN upper_bound END AS upper_bound, CASE WHEN in_eval AND (value < lower_bound OR value > upper_bound) THEN 1 ELSE 0 END AS flag FROM e"),
        ("z", "SELECT *, CASE WHEN flag = 1 AND ts = max(CASE WHEN flag = 1 THEN ts END) OVER (PARTITION BY series_id) THEN 1 ELSE 0 END AS newest FROM s"),
    )
    flag = {"full": "flag", "latest_only": "newest", "dedupe": f"CASE WHEN flag = 1 AND ts % 3 = 0 THEN 0 ELSE flag END"}[mode]
    return with_ctes("pts", *l1_ctes(), *shown) + f"SELECT series_id, ts, value, {rounded_sql(RESULT)}, {flag} AS anomaly FROM z"


def _register(name: str, window: int, mode: str) -> None:
    options = FunnelOptions(trend="daily", bucket_slot_secs=3_600, eval_window_secs=window, alert_output_mode=mode)

    def run(spark, folder):
        now = current(spark, folder)
        alerted = now.where(F.col("ts") % 3 == 0) if mode == "dedupe" else None
        found = funnel.detect_funnel(now, history(spark, folder), options, alerted=alerted)
        return rounded(found, *RESULT, keep=("series_id", "ts", "value", "anomaly"))

    query(name, _funnel_sql(window or 10**9, mode))(run)


_register("funnel_full", 0, "full")
_register("funnel_latest_only", 2 * DAY, "latest_only")
_register("funnel_dedupe", 3 * DAY, "dedupe")


# -- profile upkeep --------------------------------------------------------------------------

@query(
    "upsert_points",
    with_ctes("pts", ("b", f"SELECT series_id, ts, value * 2 AS value FROM pts WHERE ts >= {T0 - 2 * DAY}"))
    + f"SELECT series_id, ts, coalesce(b.value, h.value) AS value FROM (SELECT * FROM pts WHERE ts < {T0}) h FULL JOIN b USING (series_id, ts)",
)
def upsert_points(spark, folder):
    """An overlapping batch replaces the values it repeats; ingesting it twice changes nothing."""
    batch = pts(spark, folder).where(F.col("ts") >= T0 - 2 * DAY).withColumn("value", F.col("value") * 2)
    once = profile.upsert(history(spark, folder), batch)
    return profile.upsert(once, batch)


@query(
    "evict_old_points",
    with_ctes("pts", ("m", "SELECT series_id, max(ts) AS last FROM pts GROUP BY 1"))
    + f"SELECT series_id, ts, value FROM pts JOIN m USING (series_id) WHERE ts >= last - {10 * DAY}",
)
def evict_old_points(spark, folder):
    points = pts(spark, folder)
    newest = points.groupBy("series_id").agg(F.max("ts").alias("last_seen_ts"))
    return profile.evict(points, newest, 10 * DAY)


@query(
    "remove_current_points",
    with_ctes("pts") + f"SELECT series_id, ts, value FROM pts WHERE ts < {T0 - DAY}",
)
def remove_current_points(spark, folder):
    """A stored profile that already holds the window being judged must not see it."""
    now = pts(spark, folder).where(F.col("ts") >= T0 - DAY)
    return profile.without_points(pts(spark, folder), now)


@query(
    "refresh_profile",
    with_ctes(
        "pts", HIST,
        ("m", f"SELECT series_id, max(ts) AS last FROM pts WHERE ts < {T0 + DAY} GROUP BY 1"),
        ("b", f"SELECT series_id, CAST((ts % 86400) // 3600 AS INT) AS bucket, ts, value FROM pts JOIN m USING (series_id) "
              f"WHERE ts < {T0 + DAY} AND ts >= last - {20 * DAY} AND NOT (ts >= {T0} AND value > 40)"),
        *purge_ctes("b", 3.5, 5, 10, "kept"),
    ) + "SELECT series_id, bucket, ts, value FROM kept",
)
def refresh_profile(spark, folder):
    options = FunnelOptions(trend="daily", bucket_slot_secs=3_600, lookback_days=20)
    points = pts(spark, folder)
    past, batch = history(spark, folder), points.where((F.col("ts") >= T0) & (F.col("ts") < T0 + DAY))
    meta = profile.choose_buckets(past, profile.wanted_buckets(past, options), options)
    _, samples = profile.refresh_profile(meta, past, batch, batch.where(F.col("value") > 40), options)
    return samples
