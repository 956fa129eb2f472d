"""Windowed features of a series; every window is bounded and runs over blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import rolling

WINDOW_ROWS = 5
EWM_ALPHA = 0.3
EWM_ROWS = 128  # 0.7^127 is 2e-20: the older rows cannot change a double
STATISTICS = ("moving_avg", "moving_std", "rolling_min", "rolling_max", "ewm")
FOREST_FEATURES = ("f_time", "f_value", "f_lag", "f_mean")


def rolling_statistics(
    indexed: DataFrame,
    periods: Sequence[int] = (),
    rows: int = WINDOW_ROWS,
    value: str = "value",
) -> DataFrame:
    """Moving mean, population std, min, max, exponential mean, and a lag per period.

    Windows grow at the start of a series; a lag before the start is the first value.
    """
    def recent(w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(-(rows - 1), 0)

    columns = {
        "moving_avg": lambda w: F.avg(value).over(recent(w)),
        "moving_std": lambda w: F.stddev_pop(value).over(recent(w)),
        "rolling_min": lambda w: F.min(value).over(recent(w)),
        "rolling_max": lambda w: F.max(value).over(recent(w)),
        "_seen": lambda w: F.collect_list(value).over(w.rowsBetween(-(EWM_ROWS - 1), 0)),
    }
    for p in periods:
        # Rows before position p sit in the first block, where "first" is the series' first value.
        columns[f"lag_{p}"] = lambda w, p=p: F.coalesce(
            F.lag(value, p).over(w), F.first(value).over(w.rowsBetween(-p, 0))
        )
    wide = rolling(indexed, columns, back=max([EWM_ROWS, rows, *periods]))
    ewm = F.aggregate(
        "_seen", F.get("_seen", F.lit(0)),
        lambda acc, v: F.lit(EWM_ALPHA) * v + F.lit(1.0 - EWM_ALPHA) * acc,
    )
    return wide.withColumn("ewm", ewm).drop("_seen")


def forest_features(indexed: DataFrame, time: str = "ts", value: str = "value") -> DataFrame:
    """Time, value, previous value and mean of the five values before, as raw columns."""
    def first(w: WindowSpec) -> Column:
        return F.first(value).over(w.rowsBetween(-5, 0))

    wide = rolling(indexed, {
        "f_lag": lambda w: F.coalesce(F.lag(value).over(w), F.col(value)),
        "_five": lambda w: F.avg(value).over(w.rowsBetween(-5, -1)),
        "_first": first,
    }, back=5)
    mean = F.when(F.col("rn") >= 5, F.col("_five")).otherwise(F.col("_first"))
    return (
        wide.withColumn("f_time", F.col(time).cast("double")).withColumn("f_value", F.col(value))
        .withColumn("f_mean", mean).drop("_five", "_first")
    )


def feature_scaling(features: DataFrame) -> DataFrame:
    """Mean and population std of each forest feature per series."""
    return features.groupBy("series_id").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in FOREST_FEATURES],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in FOREST_FEATURES],
    )


def standardise(features: DataFrame, scaling: DataFrame) -> DataFrame:
    """z-score the forest features with stored means and stds; no spread gives 0."""
    wide = attach(features, scaling)
    for c in FOREST_FEATURES:
        std = F.col(f"{c}_std")
        wide = wide.withColumn(c, F.when(std > 0, (F.col(c) - F.col(f"{c}_mean")) / std).otherwise(F.lit(0.0)))
    return wide.drop(*[f"{c}_{x}" for c in FOREST_FEATURES for x in ("mean", "std")])


def trailing_residual(indexed: DataFrame, rows: int, value: str = "value") -> DataFrame:
    """Value minus the mean of the last `rows` values; the first rows without a full window drop out."""
    wide = rolling(indexed, {"residual": lambda w: F.col(value) - F.avg(value).over(w.rowsBetween(-(rows - 1), 0))},
                   back=rows - 1)
    return wide.where(F.col("rn") >= rows - 1)


def naive_errors(indexed: DataFrame, value: str = "value") -> DataFrame:
    """|change from the previous value|, NULL on the first row."""
    return rolling(indexed, {"naive_error": lambda w: F.abs(F.col(value) - F.lag(value).over(w))}, back=1)
