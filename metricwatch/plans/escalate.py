"""The second funnel level: series with undecided points go to the detector that suits them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.functions.season import TRENDS
from metricwatch.operators.aggregates import population_skewness
from metricwatch.options import ClassifierOptions, DynamicsOptions, ForecastOptions, FunnelOptions, OutlierOptions
from metricwatch.plans.classify import classify, route
from metricwatch.plans.dynamics import detect_dynamics
from metricwatch.plans.forecast import detect_forecast
from metricwatch.plans.outlier import detect_outliers
from metricwatch.session import cut_lineage

POINTS = ("series_id", "ts", "value")


def decisions(history: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> DataFrame:
    """Class and routing decision per series."""
    skew = history.groupBy("series_id").agg(population_skewness("value").alias("skew"))
    kinds = classify(history, options).select("series_id", "kind", "periods", "confidence")
    decided = route(F.col("kind"), F.col("skew"), F.col("periods"), F.col("confidence"))
    return kinds.join(skew, "series_id").select("series_id", "kind", decided.alias("decision"))


def second_level(l1: DataFrame, history: DataFrame, meta: DataFrame, options: FunnelOptions) -> DataFrame:
    """`series_id, ts, l2_baseline, l2_lower, l2_upper, l2_anomaly` for series with undecided points.

    Series are sorted to their detector first; each detector then sees only its own.
    """
    open_series = l1.where(F.col("verdict") == "uncertain").select("series_id").distinct()
    past = history.select(*POINTS).join(open_series, "series_id", "left_semi")
    chosen = cut_lineage(
        decisions(past).join(meta.select("series_id", "effective_trend"), "series_id")
        .select("series_id", "effective_trend", "decision.method")
    )
    groups = {tuple(r) for r in chosen.select("method", "effective_trend").distinct().collect()}

    def part(points: DataFrame, method: str, trend: str | None = None) -> DataFrame:
        mine = chosen.where(F.col("method") == method)
        if trend is not None:
            mine = mine.where(F.col("effective_trend") == trend)
        return points.select(*POINTS).join(mine.select("series_id"), "series_id", "left_semi")

    found = []
    if any(m == "outlier" for m, _ in groups):
        both = part(past, "outlier").withColumn("_now", F.lit(0)).unionByName(
            part(l1, "outlier").withColumn("_now", F.lit(1)))
        whole = both.groupBy("series_id", "ts").agg(F.max_by("value", "_now").alias("value"))
        flags = detect_outliers(whole, OutlierOptions(periods=options.periods))
        kept = flags.join(part(l1, "outlier").select("series_id", "ts"), ["series_id", "ts"], "left_semi")
        none = F.lit(None).cast("double")
        found.append(kept.select("series_id", "ts", F.col("value").alias("baseline"), none.alias("lower_bound"),
                                 none.alias("upper_bound"), "anomaly"))
    if any(m == "forecast" for m, _ in groups):
        bands = ForecastOptions(periods=options.periods, std_dev_multiplier=options.std_dev_multiplier, iterations=options.forecast_iterations)
        found.append(detect_forecast(part(l1, "forecast"), part(past, "forecast"), bands))
    for trend in TRENDS:
        if ("baseline", trend) in groups:
            rule = DynamicsOptions(trend, std_dev_multiplier=options.std_dev_multiplier)
            found.append(detect_dynamics(part(l1, "baseline", trend), part(past, "baseline", trend), rule))
    columns = ("series_id", "ts", "baseline", "lower_bound", "upper_bound", "anomaly")
    names = ("series_id", "ts", "l2_baseline", "l2_lower", "l2_upper", "l2_anomaly")
    if not found:
        return l1.sparkSession.createDataFrame(
            [], "series_id string, ts long, l2_baseline double, l2_lower double, l2_upper double, l2_anomaly int")
    out = found[0].select(*columns)
    for other in found[1:]:
        out = out.unionByName(other.select(*columns))
    return out.toDF(*names)
