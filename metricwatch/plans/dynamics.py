"""Seasonal mean bands: which current points leave the band of their bucket?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.functions import season
from metricwatch.operators.joins import attach_checked
from metricwatch.options import DynamicsOptions

RESULT = ("series_id", "ts", "value", "baseline", "lower_bound", "upper_bound", "anomaly")


def split_roles(points: DataFrame, start: int, boundary: int, end: int | None = None) -> DataFrame:
    """One scan, two roles: history [start, boundary) and current [boundary, end)."""
    kept = points.where(F.col("ts") >= start)
    if end is not None:
        kept = kept.where(F.col("ts") < end)
    return kept.withColumn("role", F.when(F.col("ts") < boundary, "history").otherwise("current"))


def lookback(history: DataFrame, current: DataFrame, days: int) -> DataFrame:
    """History within `days` before each series' first current point, and before it."""
    starts = current.groupBy("series_id").agg(F.min("ts").alias("_t0"))
    return attach_checked(history, starts, how="inner").where(
        (F.col("ts") >= F.col("_t0") - days * season.DAY) & (F.col("ts") < F.col("_t0"))
    ).drop("_t0")


def moments(value: Column) -> list[Column]:
    """Count, mean and population standard deviation; Spark merges centred moments, so a high level costs no digits."""
    return [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")]


def bucket_moments(samples: DataFrame, keys: Sequence[str] = ("series_id", "bucket")) -> DataFrame:
    """Count, mean and standard deviation per bucket; partial moments before the shuffle."""
    return samples.where(F.col("value").isNotNull()).groupBy(*keys).agg(*moments(F.col("value")))


def with_neighbours(
    buckets: DataFrame,
    columns: Sequence[str],
    count: Column,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Put the previous and next bucket's columns (`prev_*`, `next_*`) on each bucket row.

    Bucket numbers wrap at `count`; a bucket that does not exist gives NULLs. The window runs
    over bucket rows, of which a series has at most 31 days of slots.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("bucket", *columns)
    wide = (
        buckets.withColumn("_n", count)
        .withColumn("_prev", F.coalesce(F.lag(row).over(order), F.last(row).over(whole)))
        .withColumn("_next", F.coalesce(F.lead(row).over(order), F.first(row).over(whole)))
    )
    for side, number in (
        ("prev", season.previous_bucket(F.col("bucket"), F.col("_n"))),
        ("next", season.next_bucket(F.col("bucket"), F.col("_n"))),
    ):
        found = F.col(f"_{side}.bucket") == number
        for c in columns:
            wide = wide.withColumn(f"{side}_{c}", F.when(found, F.col(f"_{side}.{c}")))
    return wide.drop("_n", "_prev", "_next")


def blended(name: str, w_prev: str = "_wp", w_next: str = "_wn") -> Column:
    """Weighted mix of a bucket column and its neighbours; a missing neighbour's weight goes back."""
    here, before, after = F.col(name), F.col(f"prev_{name}"), F.col(f"next_{name}")
    wp = F.when(before.isNull(), F.lit(0.0)).otherwise(F.col(w_prev))
    wn = F.when(after.isNull(), F.lit(0.0)).otherwise(F.col(w_next))
    mixed = (
        wp * F.coalesce(before, here) + (F.lit(1.0) - wp - wn) * here + wn * F.coalesce(after, here)
    )
    return F.when((wp == 0.0) & (wn == 0.0), here).otherwise(mixed)


def flag_outside(value: Column, lower: Column, upper: Column) -> Column:
    """1 where the value lies outside a known band, else 0."""
    return F.coalesce(((value < lower) | (value > upper)).cast("int"), F.lit(0))


def detect_dynamics(
    current: DataFrame,
    history: DataFrame,
    options: DynamicsOptions = DynamicsOptions(),
) -> DataFrame:
    """Flag current points outside mean ± k·std of their (softly blended) hour bucket.

    History is reduced to bucket rows by partial aggregation; only those meet the current
    points. A series or bucket without history gets NULL bounds and no flag.
    """
    trend = options.trend
    samples = lookback(history, current, options.lookback_days).withColumn(
        "bucket", season.season_key(F.col("ts"), trend)
    )
    return score_dynamics(current, bucket_moments(samples), options)


def score_dynamics(current: DataFrame, buckets: DataFrame, options: DynamicsOptions) -> DataFrame:
    """Flag points against bucket rows (`series_id, bucket, mean, std`), stored or fresh."""
    trend = options.trend
    wide = with_neighbours(
        buckets.select("series_id", "bucket", "mean", "std"), ["mean", "std"],
        season.bucket_count(trend, season.HOUR),
    )
    keyed = current.withColumn("bucket", season.season_key(F.col("ts"), trend))
    transition = 0 if trend == "none" else options.transition_secs
    w_prev, w_next = season.blend_weights(F.col("ts"), season.HOUR, transition)
    reach = F.lit(options.std_dev_multiplier) * F.col("_std")
    lower = F.when(F.col("_mean").isNotNull(), F.greatest(F.col("_mean") - reach, F.lit(0.0)))
    return (
        attach_checked(keyed, wide, ["series_id", "bucket"])
        .select("series_id", "ts", "value", w_prev.alias("_wp"), w_next.alias("_wn"),
                *[c for c in wide.columns if c not in ("series_id", "bucket")])
        .select("series_id", "ts", "value", blended("mean").alias("_mean"), blended("std").alias("_std"))
        .select("series_id", "ts", "value", F.col("_mean").alias("baseline"),
                lower.alias("lower_bound"), (F.col("_mean") + reach).alias("upper_bound"))
        .withColumn("anomaly", flag_outside(F.col("value"), F.col("lower_bound"), F.col("upper_bound")))
    )
