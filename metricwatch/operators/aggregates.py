"""Per-series and per-bucket statistics built from partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.functions import season
from metricwatch.operators.joins import attach

LOW_SKEW, HIGH_SKEW = 0.5, 1.0  # fixed values: routing thresholds on |skewness|


def population_skewness(value: Column | str) -> Column:
    """m3 / m2^1.5; 0 for fewer than three values or no spread."""
    spread = F.var_pop(value)
    return F.when((F.count(value) < 3) | (spread <= 1e-12), F.lit(0.0)).otherwise(F.skewness(value))


def corrected_skewness(skew: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one."""
    n = n.cast("double")
    return F.when(n > 2, skew * F.sqrt((n - 1) * n) / (n - 2))


def threshold_method(skew: Column, high: str = "evt") -> Column:
    """Rule by asymmetry: mad, iqr, or `high` (evt for outliers, zscore in the funnel)."""
    size = F.abs(skew)
    return F.when(size < LOW_SKEW, "mad").when(size < HIGH_SKEW, "iqr").otherwise(F.lit(high))


def normal_density_skewness(points: DataFrame, value: str = "value") -> DataFrame:
    """Skewness of the fitted normal density at each value, per series."""
    fit = points.groupBy("series_id").agg(
        F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("n")
    )
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    density = F.exp(-z * z / 2) / (F.col("_s") * F.lit((2 * 3.141592653589793) ** 0.5))
    seen = attach(points, fit, how="inner", spread_by=value).withColumn("_d", density)
    return seen.groupBy("series_id").agg(F.skewness("_d").alias("pdf_skew"), F.first("n").alias("n"))


def describe(points: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Count, mean, spread, extremes, shape and coefficient of variation."""
    v = "value"
    stats = points.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"),
        F.stddev_samp(v).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
    )
    size = F.abs("mean")
    return stats.withColumn("cv", F.when(size > 1e-10, F.col("std_dev") / size).otherwise(F.lit(0.0)))


def group_effect(points: DataFrame, group: Column, name: str) -> DataFrame:
    """Variance of unweighted group means over the variance of all points, per series."""
    cells = points.where(F.col("value").isNotNull()).groupBy("series_id", group.alias("_g")).agg(
        F.sum("value").alias("_s"), F.count("value").alias("_n"), F.avg("value").alias("_mean"),
        F.var_pop("value").alias("_var"),
    )
    # Total variance = mean of the cells' variances and of their squared distance to the grand mean.
    total = cells.groupBy("series_id").agg(
        F.sum("_n").alias("_n"), F.sum("_s").alias("_s"),
        F.sum(F.col("_n") * F.col("_var")).alias("_within"),
        F.var_pop("_mean").alias("_between"), F.count(F.lit(1)).alias("_groups"),
        F.collect_list(F.struct("_n", "_mean")).alias("_cells"),
    )
    grand = F.col("_s") / F.col("_n")
    across = F.aggregate(
        "_cells", F.lit(0.0),
        lambda acc, c: acc + c["_n"] * (c["_mean"] - grand) * (c["_mean"] - grand),
    )
    variance = (F.col("_within") + across) / F.col("_n")
    effect = F.when(
        (F.col("_groups") < 2) | (F.col("_n") < 2) | (variance <= 1e-12), F.lit(0.0)
    ).otherwise(F.col("_between") / variance)
    return total.select("series_id", effect.alias(name))


def hour_effect(points: DataFrame) -> DataFrame:
    hour = F.floor(season.second_of_day(F.col("ts")) / 3_600).cast("int")
    return group_effect(points, hour, "hour_effect")


def weekday_effect(points: DataFrame) -> DataFrame:
    return group_effect(points, season.weekday(F.col("ts")), "weekday_effect")


def day_mate_strength(points: DataFrame, step: int | None = None, value: str = "value") -> DataFrame:
    """|Autocorrelation| with the point exactly one day earlier, per series."""
    stats = points.groupBy("series_id").agg(
        F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.count(value).alias("_n")
    )
    mates = points.select("series_id", (F.col("ts") + season.DAY).alias("ts"), F.col(value).alias("_mate"))
    pairs = points.join(mates, ["series_id", "ts"])
    # Σ(x-m)(y-m) from plain sums, so that the mean is not needed on every pair.
    sums = pairs.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_pairs"), F.sum(value).alias("_x"), F.sum("_mate").alias("_y"),
        F.sum(F.col(value) * F.col("_mate")).alias("_xy"),
    )
    m = F.col("_mean")
    cross = F.col("_xy") - m * F.col("_x") - m * F.col("_y") + F.col("_pairs") * m * m
    strength = F.least(F.abs(cross / (F.col("_pairs") * F.col("_var"))), F.lit(1.0))
    known = (F.col("_n") >= 10) & (F.col("_var") > 1e-12) & (F.col("_pairs") >= 2)
    return stats.join(sums, "series_id", "left").select(
        "series_id", F.when(known, strength).otherwise(F.lit(0.0)).alias("day_strength"),
        F.coalesce("_pairs", F.lit(0)).alias("pairs"),
    )


def sparse_ratio(buckets: DataFrame, bucket_count: Column, min_samples: int) -> DataFrame:
    """Share of all buckets, empty ones included, that hold fewer than `min_samples`."""
    return buckets.groupBy("series_id").agg(
        F.count_if(F.col("count") >= min_samples).alias("_full"), F.max(bucket_count).alias("buckets")
    ).select("series_id", "buckets", (F.lit(1.0) - F.col("_full") / F.col("buckets")).alias("sparse_ratio"))
