"""Quality of detections and forecasts against known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The quality gates.
MIN_F1, MIN_RECALL = 0.80, 0.85
MAX_MASE, MAX_ERROR_SHARE = 1.0, 0.95
MAX_CLEAN_FALSE_RATE = 0.05


def align(result: DataFrame, labels: DataFrame) -> DataFrame:
    """Detections with the label of the same series and time; times known to one side only drop out."""
    return result.join(labels.select("series_id", "ts", "label"), ["series_id", "ts"])


def display_to_binary(shown: Column) -> Column:
    """1 where an anomaly value is shown."""
    return (shown.isNotNull() & ~F.isnan(shown)).cast("int")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def detection_quality(aligned: DataFrame, flag: str = "anomaly", label: str = "label") -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 per series, with gates."""
    hit, real = F.col(flag) >= 0.5, F.col(label) == 1
    counts = aligned.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = counts.withColumn("precision", _share(tp, tp + fp)).withColumn("recall", _share(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return (
        rated.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
        .withColumn("passed", (F.col("f1") >= MIN_F1) & (r >= MIN_RECALL))
        .withColumn("clean_passed", fp <= MAX_CLEAN_FALSE_RATE * F.col("n"))
    )


def naive_quality(with_errors: DataFrame) -> DataFrame:
    """Mean absolute and root mean square error of predicting the previous value."""
    e = F.col("naive_error")
    return with_errors.groupBy("series_id").agg(
        F.coalesce(F.avg(e), F.lit(0.0)).alias("naive_mae"),
        F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)).alias("naive_rmse"),
    )


def forecast_quality(predictions: DataFrame, training_naive: DataFrame, naive: DataFrame) -> DataFrame:
    """MAE, RMSE and MASE per series, and whether they beat the naive forecast by the gates.

    `training_naive` scales the MASE; `naive` is the naive quality on the evaluated window.
    """
    gap = F.col("value") - F.col("pred")
    errors = predictions.groupBy("series_id").agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    scale = training_naive.select("series_id", F.col("naive_mae").alias("_scale"))
    mase = F.when(F.col("_scale") > 0, F.col("mae") / F.col("_scale")).otherwise(F.lit(float("inf")))
    return errors.join(scale, "series_id").join(naive, "series_id").withColumn("mase", mase).withColumn(
        "passed",
        (F.col("mase") < MAX_MASE) & (F.col("mae") <= MAX_ERROR_SHARE * F.col("naive_mae"))
        & (F.col("rmse") <= MAX_ERROR_SHARE * F.col("naive_rmse")),
    ).drop("_scale")
