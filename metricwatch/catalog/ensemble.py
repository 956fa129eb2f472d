"""Queries: decomposition, change points, isolation forest and the outlier detectors on top."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricwatch.catalog.classify import MA, wavy
from metricwatch.catalog.outliers import robust_ctes
from metricwatch.catalog.prepare import pts
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.catalog.statistics import rounded, rounded_sql
from metricwatch.functions.numeric import q_sql
from metricwatch.operators import changepoint, decompose, forest
from metricwatch.operators.ordered import row_index
from metricwatch.options import OutlierOptions
from metricwatch.plans.outlier import detect_outliers
from metricwatch.sources.points import read_daily_orders

HN = ("hn", "SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hx")


def season_ctes(src: str, period: int, out: str) -> tuple:
    h = period // 2
    w = f"OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    return (
        (f"{out}d", f"SELECT *, rest - avg(rest) {w} AS away, rn % {period} AS phase FROM {src}"),
        (f"{out}m", f"SELECT series_id, phase, median(away) AS med FROM {out}d GROUP BY 1, 2"),
        (f"{out}l", f"SELECT series_id, phase, med - avg(med) OVER (PARTITION BY series_id) AS season FROM {out}m"),
        (out, f"SELECT d.* EXCLUDE (rest, away, phase), season AS season_{period}, rest - season AS rest FROM {out}d d JOIN {out}l USING (series_id, phase)"),
    )


def decompose_ctes(periods: tuple[int, ...]) -> tuple:
    steps, here = [("r0", "SELECT *, value AS rest FROM hn")], "r0"
    for p in periods:
        steps += season_ctes(here, p, f"s{p}_")
        here = f"s{p}_"
    h = max(periods) // 2
    steps.append(("dc", f"SELECT * EXCLUDE (rest), avg(rest) OVER w AS trend, rest - avg(rest) OVER w AS residual FROM {here} "
                        f"WINDOW w AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"))
    return tuple(steps)


def wave_rows(spark, folder):
    return row_index(wavy(spark, folder).drop("rn"), total="n")


@query(
    "seasonal_decomposition",
    with_ctes("raw", *MA, HN, *decompose_ctes((12, 24)))
    + f"SELECT series_id, ts, {rounded_sql(['trend', 'season_12', 'season_24', 'residual'])} FROM dc",
)
def seasonal_decomposition(spark, folder):
    parts = decompose.decompose(wave_rows(spark, folder), [24, 12])
    return rounded(parts, "trend", "season_12", "season_24", "residual", keep=("series_id", "ts"))


@query(
    "seasonal_strength",
    with_ctes("raw", *MA, HN, *decompose_ctes((12, 24)),
              ("st", "SELECT series_id, 1 - var_pop(residual) / var_pop(season_12 + residual) AS strength_12, 1 - var_pop(residual) / var_pop(season_24 + residual) AS strength_24 FROM dc GROUP BY 1"))
    + f"SELECT series_id, {rounded_sql(['strength_12', 'strength_24'])}, concat_ws(',', CASE WHEN strength_12 >= 0.8 THEN '12' END, CASE WHEN strength_24 >= 0.8 THEN '24' END) AS periods FROM st",
)
def seasonal_strength(spark, folder):
    found = decompose.strengths(decompose.decompose(wave_rows(spark, folder), [12, 24]), [12, 24])
    found = found.withColumn("periods", F.array_join(F.transform("periods", lambda p: p.cast("string")), ","))
    return rounded(found, "strength_12", "strength_24", keep=("series_id", "periods"))


@query(
    "usable_periods",
    with_ctes("didx", ("z", "SELECT series_id, any_value(n) AS n FROM didx GROUP BY 1"))
    + "SELECT series_id, array_to_string(list_filter([7, 30, 365, 900], lambda p: p * 2 <= n), ',') AS periods FROM z",
)
def usable_periods(spark, folder):
    sizes = read_daily_orders(spark, folder).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    asked = F.array(*[F.lit(p) for p in (7, 7, 30, 365, 900, 30)])
    kept = F.transform(decompose.usable_periods(asked, F.col("n")), lambda p: p.cast("string"))
    return sizes.select("series_id", F.array_join(kept, ",").alias("periods"))


@query("auto_decomposition")
def auto_decomposition(spark, folder):
    """Periods found per series and how much variance is left after taking them off."""
    rest = decompose.auto_decompose(wave_rows(spark, folder))
    return rest.groupBy("series_id").agg(
        F.array_join(F.transform(F.first("periods"), lambda p: p.cast("string")), ",").alias("periods"),
        (F.var_pop("y") / F.var_pop("value")).alias("left_over"))


@query(
    "outlier_lite_seasonal",
    with_ctes(
        "raw", *MA, HN, *decompose_ctes((24,)),
        ("stz", "SELECT series_id, 1 - var_pop(residual) / var_pop(season_24 + residual) AS s FROM dc GROUP BY 1"),
        ("p", "SELECT series_id, ts, CASE WHEN s >= 0.8 THEN residual ELSE value END AS value FROM dc JOIN stz USING (series_id)"),
        *robust_ctes("p"),
    ) + "SELECT series_id, ts, anomaly FROM flags",
)
def outlier_lite_seasonal(spark, folder):
    """Residuals where a strong daily season exists, then the skewness-routed fences."""
    return detect_outliers(wavy(spark, folder).drop("rn"), OutlierOptions(periods=(24,))).select("series_id", "ts", "anomaly")


SPLIT = (
    ("sg", "SELECT series_id, rn, value AS v, sum(value) OVER (PARTITION BY series_id ORDER BY rn) - value AS before, n FROM shifted"),
    ("sp", "SELECT series_id, sum(v) AS total, 2.0 * var_pop(v) * ln(count(*)) AS penalty FROM sg GROUP BY 1"),
    ("gn", "SELECT series_id, rn, penalty, before * before / rn + (total - before) * (total - before) / (n - rn) - total * total / n AS gain FROM sg JOIN sp USING (series_id) WHERE rn >= 5 AND n - rn >= 5"),
    ("bk", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gain DESC, rn) AS r FROM gn"),
)
SHIFTED = ("shifted", "SELECT series_id, ts, rn, n, CASE WHEN rn > n * 0.6 THEN value + 30 ELSE value END AS value FROM idx")


def shifted(spark, folder):
    """Points whose last two fifths lie higher."""
    rows = row_index(pts(spark, folder), total="n")
    return rows.withColumn("value", F.when(F.col("rn") > F.col("n") * 0.6, F.col("value") + 30).otherwise(F.col("value")))


@query(
    "first_change_point",
    with_ctes("idx", SHIFTED, *SPLIT) + f"SELECT series_id, rn AS split, {q_sql('gain', 1)} AS gain FROM bk WHERE r = 1 AND gain > penalty",
)
def first_change_point(spark, folder):
    splits = changepoint.best_splits(changepoint.prepare_segments(shifted(spark, folder)))
    return rounded(splits, "gain", keep=("series_id", "split"), digits=1)


@query("change_points")
def change_points(spark, folder):
    return changepoint.change_points(shifted(spark, folder))


@query("isolation_forest")
def isolation_forest(spark, folder):
    """Forest scores of all points of all series."""
    return forest.forest_scores(row_index(pts(spark, folder)), OutlierOptions())


@query("outlier_full")
def outlier_full(spark, folder):
    return detect_outliers(pts(spark, folder), OutlierOptions(detect_mode="full"))
