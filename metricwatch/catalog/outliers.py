"""Queries: robust outlier flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricwatch.catalog.prepare import pts
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.catalog.statistics import pdf_skew_ctes
from metricwatch.operators import outliers
from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import row_index
from metricwatch.sources.points import read_events

LOG = ("p", "SELECT series_id, ts, ln(value + 1) AS value FROM pts")
RAW = ("p", "SELECT series_id, ts, value FROM pts")


def robust_ctes(src: str) -> tuple:
    """SQL of the three fences and the skewness route over `src(series_id, ts, value)`."""
    return (
        ("u", f"SELECT series_id, avg(value) AS mu, count(*) AS n, median(value) AS med, quantile_cont(value, 0.25) AS q1, "
              f"quantile_cont(value, 0.75) AS q3 FROM {src} GROUP BY 1"),
        ("a", f"SELECT s.*, mu, n, med, q1, q3, abs(value - med) AS score FROM {src} s JOIN u USING (series_id)"),
        ("k", "SELECT series_id, greatest(median(score) * 1.4826, abs(any_value(med)) * 0.005, 1e-9) AS scale, "
              "avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3 FROM a GROUP BY 1"),
        ("t", "SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC) AS r FROM a"),
        ("e", "SELECT series_id, min(score) AS evt_u, avg(score) - min(score) AS evt_m, count(*) AS c FROM t WHERE r <= 10 GROUP BY 1 HAVING count(*) = 10"),
        ("f", "SELECT a.*, scale, evt_u, evt_m, CASE WHEN n < 3 OR m2 <= 1e-12 THEN 0.0 ELSE m3 / m2 ** 1.5 END AS skew "
              "FROM a JOIN k USING (series_id) LEFT JOIN e USING (series_id)"),
        ("g", "SELECT *, CASE WHEN n < 3 THEN 'none' WHEN abs(skew) < 0.5 THEN 'mad' WHEN abs(skew) < 1.0 THEN 'iqr' WHEN n < 20 THEN 'mad' ELSE 'evt' END AS method, "
              "CAST(score > 3.0 * scale AS INT) AS mad_flag, CAST(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS INT) AS iqr_flag, "
              "CASE WHEN score > evt_u AND evt_m > 0 AND exp(-(score - evt_u) / evt_m) < 0.1 THEN 1 ELSE 0 END AS evt_flag FROM f"),
        ("flags", "SELECT *, CASE method WHEN 'mad' THEN mad_flag WHEN 'iqr' THEN iqr_flag WHEN 'evt' THEN evt_flag ELSE 0 END AS anomaly FROM g"),
    )


def log_points(spark, folder):
    return pts(spark, folder).withColumn("value", F.ln(F.col("value") + 1))


@query(
    "fence_flags",
    with_ctes("pts", LOG, *robust_ctes("p")) + "SELECT series_id, ts, mad_flag, iqr_flag, evt_flag FROM flags",
)
def fence_flags(spark, folder):
    """The MAD, IQR and extreme-value rule side by side."""
    points = log_points(spark, folder)
    wide = attach(points, outliers.robust_fences(points))
    return wide.select("series_id", "ts", *[f.alias(f"{n}_flag") for n, f in outliers.flag_columns().items()])


@query(
    "outlier_lite",
    with_ctes("pts", RAW, *robust_ctes("p")) + "SELECT series_id, ts, value, method, anomaly FROM flags",
)
def outlier_lite(spark, folder):
    points = pts(spark, folder)
    return outliers.gated(points, outliers.robust_flags(points)).select("series_id", "ts", "value", "method", "anomaly")


@query(
    "outlier_lite_per_user",
    with_ctes(
        ("p", "SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, "
              "ln(arg_max(value, event_id) + 1) AS value FROM events GROUP BY 1, 2"),
        *robust_ctes("p"))
    + "SELECT series_id, ts, method, anomaly FROM flags",
)
def outlier_lite_per_user(spark, folder):
    """Many short series, which take all three routes."""
    from metricwatch.sources.points import canonical

    points = canonical(read_events(spark, folder, series=F.col("user_id").cast("string")))
    points = points.withColumn("value", F.ln(F.col("value") + 1))
    return outliers.gated(points, outliers.robust_flags(points)).select("series_id", "ts", "method", "anomaly")


def rolling_ctes(src: str, value: str) -> tuple:
    w = "OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    return (
        ("w0", f"SELECT *, quantile_cont({value}, 0.25) {w} AS w25, quantile_cont({value}, 0.75) {w} AS w75, "
               f"quantile_cont({value}, 0.01) {w} AS w1, quantile_cont({value}, 0.99) {w} AS w99 FROM {src}"),
        ("w", f"SELECT *, CASE WHEN rn < 5 THEN 0 WHEN {value} < w1 - 2 * (w75 - w25) OR {value} > w99 + 2 * (w75 - w25) THEN 1 ELSE 0 END AS rolling_flag FROM w0"),
    )


@query(
    "rolling_iqr_flags",
    with_ctes("idx", *rolling_ctes("idx", "value")) + "SELECT series_id, ts, rolling_flag FROM w",
)
def rolling_iqr_flags(spark, folder):
    return outliers.rolling_iqr_flags(row_index(pts(spark, folder))).select("series_id", "ts", "rolling_flag")


SCORED = (
    ("lg", "SELECT series_id, ts, rn, n, CASE WHEN series_id < 'e' THEN value ELSE ln(value + 1) END AS value FROM idx"),
    ("mu", "SELECT series_id, avg(value) AS mu, stddev_pop(value) AS sd FROM lg GROUP BY 1"),
    ("sc", "SELECT lg.*, abs(value - mu) / sd AS score FROM lg JOIN mu USING (series_id)"),
)


@query(
    "score_threshold",
    with_ctes(
        "idx", *SCORED, *pdf_skew_ctes("sc"), *rolling_ctes("sc", "score"),
        ("t", "SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC) AS r FROM sc"),
        ("e", "SELECT series_id, min(score) AS u, avg(score) - min(score) AS m FROM t WHERE r <= 10 GROUP BY 1"),
    )
    + "SELECT series_id, ts, CASE WHEN abs(pdf_skew) >= 1.0 THEN CASE WHEN score > u AND m > 0 AND exp(-(score - u) / m) < 0.1 THEN 1 ELSE 0 END "
    "WHEN abs(pdf_skew) >= 0.8 THEN rolling_flag ELSE 0 END AS anomaly FROM w JOIN pk USING (series_id) LEFT JOIN e USING (series_id)",
)
def score_threshold(spark, folder):
    points = pts(spark, folder)
    points = points.withColumn("value", F.when(F.col("series_id") < "e", F.col("value")).otherwise(F.ln(F.col("value") + 1)))
    stats = points.groupBy("series_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    scored = attach(row_index(points), stats).withColumn("score", F.abs(F.col("value") - F.col("_m")) / F.col("_s"))
    return outliers.score_flags(scored.drop("_m", "_s")).select("series_id", "ts", "anomaly")


@query(
    "evt_fit",
    with_ctes("raw", ("t", "SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY value DESC) AS r FROM raw"))
    + "SELECT series_id, min(value) AS evt_start, CAST(floor((avg(value) - min(value)) * 1e6 + 0.537) AS DOUBLE) / 1e6 AS evt_excess FROM t WHERE r <= 10 GROUP BY 1",
)
def evt_fit(spark, folder):
    from metricwatch.functions.numeric import q

    return outliers.evt_fit(read_events(spark, folder), "value").select("series_id", "evt_start", q("evt_excess").alias("evt_excess"))
