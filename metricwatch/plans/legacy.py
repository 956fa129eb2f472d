"""The older baseline: history by weekday or day of month and hour, current by interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.functions import season
from metricwatch.functions.numeric import confidence_multiplier
from metricwatch.operators.joins import attach
from metricwatch.options import LOOKBACK_DAYS, LegacyBaselineOptions
from metricwatch.plans.dynamics import flag_outside, lookback, moments


def _season(trend: str):
    ts = F.col("ts")
    return {"weekly": season.weekday(ts), "monthly": season.day_of_month(ts)}.get(trend, F.lit(0)).cast("int")


def detect_legacy_baseline(
    current: DataFrame, history: DataFrame, options: LegacyBaselineOptions = LegacyBaselineOptions()
) -> DataFrame:
    """Interval means of current points against mean ± k·std of their season and hour.

    Daily keeps dates apart, weekly and monthly fold them together. Without a trend every
    bound is NULL. k is `std_dev_multiplier`, else that of `confidence_level`, else 2.
    """
    if options.trend == "none":
        null = F.lit(None).cast("double")
        return current.select("series_id", "ts", "value", null.alias("baseline"), null.alias("lower_bound"),
                              null.alias("upper_bound"), F.lit(0).alias("anomaly"))
    hour = F.floor(season.second_of_day(F.col("ts")) / 3_600).cast("int")
    key = _season(options.trend)
    past = lookback(history, current, LOOKBACK_DAYS[options.trend]).where(F.col("value").isNotNull())
    buckets = past.groupBy("series_id", key.alias("season"), hour.alias("hour")).agg(*moments(F.col("value")))
    day = season.day_number(F.col("ts")) if options.trend == "daily" else F.lit(0)
    now = current.groupBy(
        "series_id", key.alias("season"), hour.alias("hour"),
        season.interval_end_minute(F.col("ts"), options.interval_mins).alias("interval_end"), day.alias("day"),
    ).agg(F.min("ts").alias("ts"), F.avg("value").alias("value"))
    k = F.lit(2.0)
    if options.std_dev_multiplier is not None:
        k = F.lit(options.std_dev_multiplier)
    elif options.confidence_level is not None:
        k = confidence_multiplier(F.lit(options.confidence_level))
    lower = F.col("mean") - k * F.col("std")
    if not options.allow_negative_bounds:
        lower = F.when(lower < 0, F.lit(0.0)).otherwise(lower)
    return (
        attach(now, buckets.select("series_id", "season", "hour", "mean", "std"), ["series_id", "season", "hour"])
        .withColumn("lower_bound", lower).withColumn("upper_bound", F.col("mean") + k * F.col("std"))
        .withColumn("anomaly", flag_outside(F.col("value"), F.col("lower_bound"), F.col("upper_bound")))
        .select("series_id", "ts", "value", F.col("mean").alias("baseline"), "lower_bound", "upper_bound", "anomaly")
    )
