"""What kind of series is it, and which detector suits it?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.operators import aggregates, correlation, hypothesis
from metricwatch.operators.ordered import row_index
from metricwatch.operators.prepare import missing_gate
from metricwatch.options import ClassifierOptions

PEAK_FLOOR, PEAK_TOP = 0.2, 5
TREND_ROWS = 10  # heuristic classification needs at least this many points


def seasonality(indexed: DataFrame, options: ClassifierOptions) -> DataFrame:
    """Candidate periods with a notable autocorrelation, and their mean strength.

    A series shorter than twice the longest period allowed has none.
    """
    lags = [p for p in options.candidate_periods if p <= options.max_seasonal_period]
    order = F.array_position(F.array(*[F.lit(p) for p in lags]), F.col("lag").cast("int"))
    acf = correlation.autocorrelation(indexed, lags).where(F.col("lag") > 0)
    long_enough = (F.col("n") >= 2 * options.max_seasonal_period) & (F.col("n") >= 2 * F.col("lag"))
    strength = F.least(F.abs(F.coalesce("acf", F.lit(0.0))), F.lit(1.0))
    kept = acf.where(long_enough).withColumn("_s", strength).where(F.col("_s") > options.acf_floor)
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("lag").cast("int").alias("p"))))
    return kept.groupBy("series_id").agg(
        F.transform(pairs, lambda x: x["p"]).alias("periods"), F.least(F.avg("_s"), F.lit(1.0)).alias("strength")
    )


def periodicity(indexed: DataFrame, max_period: int) -> DataFrame:
    """The five strongest autocorrelation peaks per series up to half its length."""
    n = F.col("n")
    acf = correlation.autocorrelation(
        indexed, max_lag=F.least(F.lit(max_period), F.floor(n / 2)), limit=max_period
    ).where(n >= 4)
    found = correlation.peaks(acf, "acf", F.lit(PEAK_FLOOR)).where(F.col("acf") > PEAK_FLOOR)
    w = Window.partitionBy("series_id").orderBy(F.desc("acf"), "lag")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PEAK_TOP)
    pairs = F.sort_array(F.collect_list(F.struct("rank", "lag", "acf")))
    return best.groupBy("series_id").agg(
        F.transform(pairs, lambda x: x["lag"].cast("int")).alias("periods"),
        F.transform(pairs, lambda x: x["acf"]).alias("powers"),
    )


def classify(points: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> DataFrame:
    """One row per series: kind, direction, periods, confidence and the statistics behind it.

    A series with too few or too many missing points gets kind NULL and a reason in `gate`.
    """
    indexed = row_index(points)
    stats = aggregates.describe(points)
    tests = hypothesis.adf(indexed, options.adf_lags).join(hypothesis.kpss(indexed), "series_id")
    trend = hypothesis.linear_trend(indexed).drop("n", "std")
    season = seasonality(indexed, options).withColumnRenamed("strength", "season_strength")
    wide = (
        stats.join(missing_gate(points).select("series_id", "bad_rate"), "series_id")
        .join(tests, "series_id", "left").join(trend, "series_id", "left").join(season, "series_id", "left")
    )
    if options.use_periodicity:
        cycles = periodicity(indexed, options.max_seasonal_period // 2).select(
            "series_id", F.col("periods").alias("cycles"))
        wide = wide.join(cycles, "series_id", "left")
    else:
        wide = wide.withColumn("cycles", F.lit(None).cast("array<int>"))
    return decide_kind(wide, options)


def decide_kind(wide: DataFrame, options: ClassifierOptions) -> DataFrame:
    """Kind and confidence from the statistics; the confidences are fixed values."""
    noisy = F.col("cv") > options.irregular_cv_threshold
    steady = F.coalesce(hypothesis.is_stationary(options.stationarity_method, options.adf_significance), F.lit(True))
    seasonal = F.coalesce(
        (F.col("season_strength") > options.seasonality_strength_threshold) & (F.size("periods") > 0), F.lit(False)
    )
    cyclic = F.coalesce(F.size("cycles") > 0, F.lit(False))
    moving = F.col("slope").isNotNull()
    gate = F.when(F.col("count") < options.min_data_length, "too_short").when(F.col("bad_rate") > 0.3, "missing").otherwise("ok")
    kind = (
        F.when(F.col("gate") != "ok", F.lit(None))
        .when(noisy, "irregular")
        .when(F.col("stationary") & seasonal, "seasonal")
        .when(F.col("stationary"), "stationary")
        .when(moving & seasonal, "seasonal_trend")
        .when(moving, "trending")
        .when(seasonal, "seasonal").otherwise("stationary")
    )
    confidence = (
        F.when(noisy, 0.30)
        .when(F.col("stationary") & seasonal, 0.85).when(F.col("stationary") & cyclic, 0.70).when(F.col("stationary"), 0.90)
        .when(moving & seasonal, 0.85).when(moving, 0.80).when(seasonal, 0.75).otherwise(0.50)
    )
    heading = F.when(F.col("kind").isin("trending", "seasonal_trend"), F.when(F.col("direction") > 0, "up").otherwise("down"))
    return (
        wide.withColumn("gate", gate).withColumn("stationary", steady).withColumn("kind", kind)
        .withColumn("confidence", F.when(F.col("kind").isNotNull(), confidence))
        .withColumn("heading", heading)
        .withColumn("periods", F.when(F.col("kind").isin("seasonal", "seasonal_trend"), F.col("periods"))
                    .otherwise(F.array().cast("array<int>")))
    )


def classify_by_slope(points: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Light classification: a slope worth at least one std over the series, and known periods."""
    fit = hypothesis.linear_trend(row_index(points))
    tilted = (F.col("n") >= TREND_ROWS) & (F.col("std") > 2.220446049250313e-16) & (
        F.abs(F.col("slope") * F.col("n")) / F.col("std") >= 1.0
    )
    if periods is None:
        fit = fit.withColumn("periods", F.array().cast("array<int>"))
    else:
        fit = fit.join(periods, "series_id", "left").withColumn(
            "periods", F.coalesce("periods", F.array().cast("array<int>")))
    heading = F.when(tilted, F.when(F.col("slope") > 0, "up").otherwise("down"))
    seasonal = F.size("periods") > 0
    kind = (
        F.when(seasonal & tilted, "seasonal_trend").when(seasonal, "seasonal").when(tilted, "trending").otherwise("stationary")
    )
    return fit.select("series_id", kind.alias("kind"), heading.alias("heading"), "periods")


def route(kind: Column, skew: Column, periods: Column, confidence: Column) -> Column:
    """Detection decision for a series class, as a struct."""
    outlier = kind.isin("stationary", "seasonal")
    trending = kind.isin("trending", "seasonal_trend")
    seasonal = kind.isin("seasonal", "seasonal_trend")
    return F.struct(
        F.when(outlier, "outlier").when(trending, "forecast").when(kind == "irregular", "baseline").alias("method"),
        F.when(outlier, aggregates.threshold_method(skew)).alias("threshold"),
        trending.alias("detrend"),
        seasonal.alias("deseasonalize"),
        (kind == "stationary").alias("normalize"),
        (kind == "irregular").alias("median_filter"),
        (~outlier).alias("requires_history"),
        F.when(kind == "irregular", 3.0).otherwise(2.0).alias("std_dev_multiplier"),
        F.when(seasonal, periods).otherwise(F.array().cast("array<int>")).alias("periods"),
        confidence.alias("confidence"),
    )
