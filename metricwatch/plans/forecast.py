"""Forecast bands from boosted trees on calendar, rolling and lag features.

One model is trained on all series together; targets and value features are scaled per
series, so that a large series does not drown a small one and the model size does not grow with
the number of series. What is particular to a series reaches the trees as two more features: its own
mean of the hour and of the hour of the week. Boosting stops when the last part of each history,
kept from training, gains no more. An unknown value feature counts as the series' mean and is marked.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.functions import season
from metricwatch.functions.calendar import FEATURES, calendar_features
from metricwatch.operators.features import STATISTICS, rolling_statistics
from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import row_index
from metricwatch.options import ForecastOptions
from metricwatch.plans.dynamics import flag_outside
from metricwatch.session import cut_lineage

OWN = ("shape_day", "shape_week", "gap")
PULL = 3.0  # rows by which the mean of an hour of the week is drawn to that of the hour
VALIDATED = 50  # rows of history from which the last part of a series is kept for validation


def forecast_features(points: DataFrame, periods: tuple[int, ...] = ()) -> DataFrame:
    """Calendar, rolling and lag features of each point; windows start at the first point given."""
    rows = rolling_statistics(row_index(points), periods)
    return rows.select("*", *calendar_features(F.col("ts")))


def _value_columns(periods: tuple[int, ...]) -> list[str]:
    return [*STATISTICS, *[f"lag_{p}" for p in periods]]


def _slots() -> tuple[Column, Column]:
    """Hour of the day, and of the week, of `ts`."""
    hour = F.floor(season.second_of_day(F.col("ts")) / F.lit(3600)).cast("int")
    return hour, (season.weekday(F.col("ts")) * 24 + hour).cast("int")


def series_scale(history: DataFrame) -> DataFrame:
    """Per series its mean, spread, known rows, and sum and count of values per hour of the week (168 at most)."""
    slots = history.groupBy("series_id", _slots()[1].alias("_slot")).agg(
        F.count("value").alias("_n"), F.sum("value").alias("_sum"))
    shape = slots.where("_n > 0").groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", F.struct("_n", "_sum")))).alias("shape"))
    return history.groupBy("series_id").agg(
        F.avg("value").alias("center"), F.stddev_pop("value").alias("spread"), F.count("value").alias("history_rows")
    ).join(shape, "series_id", "left")


def _scaled(features: DataFrame, scale: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    """Features and target in units of their series; no feature is NULL."""
    wide = attach(features, scale, how="inner")
    center = F.coalesce("center", F.lit(0.0))
    unit = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0))
    hour, slot = _slots()
    cells = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.col("shape")[(d * 24 + hour).cast("int")])
    total = lambda name: F.aggregate(F.transform(cells, lambda c: F.coalesce(c[name].cast("double"), F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)
    n, own = total("_n"), F.col("shape")[slot]
    day = F.when(n > 0, total("_sum") / n).otherwise(center)
    week = (F.coalesce(own["_sum"], F.lit(0.0)) + PULL * F.col("_day")) / (F.coalesce(own["_n"], F.lit(0)) + PULL)
    wide = wide.withColumn("_day", day)
    columns = [F.col(c) for c in ("series_id", "ts", "rn", "value", "center", "spread", "history_rows", *FEATURES)]
    for c in _value_columns(periods):
        shift = F.lit(0.0) if c == "moving_std" else center
        columns.append(F.coalesce((F.col(c) - shift) / unit, F.lit(0.0)).alias(c))
    gap = F.reduce(F.array(*[F.col(c).isNull() for c in _value_columns(periods)]), F.lit(False), lambda x, y: x | y).cast("double")
    return wide.select(
        *columns, ((F.col("_day") - center) / unit).alias("shape_day"), ((week - center) / unit).alias("shape_week"),
        gap.alias("gap"), ((F.col("value") - center) / unit).alias("target"))


def _assembler(periods: tuple[int, ...]) -> VectorAssembler:
    return VectorAssembler(inputCols=[*FEATURES, *_value_columns(periods), *OWN], outputCol="features", handleInvalid="error")


def _rows(points: DataFrame, scale: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    return _assembler(periods).transform(_scaled(forecast_features(points, periods), scale, periods))


def residual_spread(history: DataFrame, model: GBTRegressionModel, scale: DataFrame, options: ForecastOptions) -> DataFrame:
    """The scale with `residual`: std of what the model leaves of this history, in units of the series."""
    plain = scale.drop("residual")
    fitted = model.transform(_rows(history, plain, options.periods)).groupBy("series_id").agg(
        F.stddev_samp(F.col("target") - F.col("scaled_pred")).alias("residual"))
    return plain.join(fitted, "series_id", "left")


def train_forecast(history: DataFrame, options: ForecastOptions = ForecastOptions()) -> tuple[GBTRegressionModel, DataFrame]:
    """`(model, scale)`: the pooled model, and per series its scale, shape and training residual std.

    The last `validation_share` of each series of VALIDATED or more rows decides when boosting stops;
    rows without a value train nothing.
    """
    scale = cut_lineage(series_scale(history))
    late = (F.col("history_rows") >= VALIDATED) & (F.col("rn") >= F.col("history_rows") * (1 - options.validation_share))
    rows = _rows(history, scale, options.periods).where("target IS NOT NULL").select("features", "target", late.alias("late"))
    booster = GBTRegressor(
        featuresCol="features", labelCol="target", predictionCol="scaled_pred", maxIter=options.iterations,
        maxDepth=options.max_depth, stepSize=options.step_size, maxBins=options.max_bins, seed=options.seed,
    )
    if options.validation_share > 0 and not scale.where(F.col("history_rows") >= VALIDATED).isEmpty():
        booster = booster.setValidationIndicatorCol("late").setParams(validationTol=options.validation_tol)
    model = booster.fit(rows)
    return model, residual_spread(history, model, scale, options)


def score_forecast(
    current: DataFrame, model: GBTRegressionModel, scale: DataFrame, options: ForecastOptions = ForecastOptions()
) -> DataFrame:
    """Predictions and bands for current points. Series with too little history get none."""
    rows = _rows(current, scale.drop("residual"), options.periods)
    unit = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0))
    enough = F.col("history_rows") >= options.n_lags
    predicted = model.transform(rows).select(
        "series_id", "ts", F.when(enough, F.col("scaled_pred") * unit + F.col("center")).alias("pred"), unit.alias("_unit"),
    )
    residual = scale.select("series_id", F.coalesce("residual", F.lit(0.0)).alias("_residual"))
    wide = attach(current.join(predicted, ["series_id", "ts"], "left"), residual)
    return forecast_bands(wide.withColumn("residual_std", F.col("_residual") * F.col("_unit")), options)


def forecast_bands(predicted: DataFrame, options: ForecastOptions = ForecastOptions()) -> DataFrame:
    """Bands of k residual stds around `pred`, and flags outside them."""
    margin = F.lit(options.std_dev_multiplier) * F.col("residual_std")
    lower: Column = F.col("pred") - margin
    if not options.allow_negative_bounds:
        lower = F.when(F.col("pred").isNotNull(), F.greatest(lower, F.lit(0.0)))
    return (
        predicted.withColumn("lower_bound", lower).withColumn("upper_bound", F.col("pred") + margin)
        .withColumn("anomaly", flag_outside(F.col("value"), F.col("lower_bound"), F.col("upper_bound")))
        .select("series_id", "ts", "value", F.col("pred").alias("baseline"), "lower_bound", "upper_bound", "anomaly")
    )


def detect_forecast(
    current: DataFrame,
    history: DataFrame | None,
    options: ForecastOptions = ForecastOptions(),
    model: tuple[GBTRegressionModel, DataFrame] | None = None,
) -> DataFrame:
    """Flag current points outside the forecast band of a model trained on history, or of a stored one.

    With a stored model the spread of the residuals comes from the history given, never from the
    current points; without history it is the stored one.
    """
    if model is None:
        model = train_forecast(history, options)
    elif history is not None:
        model = model[0], residual_spread(history, *model, options)
    return score_forecast(current, *model, options)


def save_model(model: GBTRegressionModel, scale: DataFrame, path: str) -> None:
    PipelineModel(stages=[model]).write().overwrite().save(f"{path}/model")
    scale.write.mode("overwrite").parquet(f"{path}/scale")


def load_model(spark, path: str) -> tuple[GBTRegressionModel, DataFrame]:
    return PipelineModel.load(f"{path}/model").stages[0], spark.read.parquet(f"{path}/scale")
