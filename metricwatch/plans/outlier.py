"""The outlier detector: seasonal residuals, then robust fences or the full ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.operators.changepoint import change_points
from metricwatch.operators.decompose import auto_decompose, season_residuals
from metricwatch.operators.forest import forest_scores
from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import row_index
from metricwatch.operators.outliers import gated, robust_flags, score_flags
from metricwatch.options import OutlierOptions
from metricwatch.session import delete_written, written

RESULT = ("series_id", "ts", "value", "anomaly")


def detect_outliers(points: DataFrame, options: OutlierOptions = OutlierOptions()) -> DataFrame:
    """0/1 flags per point. Constant and mostly-zero series have none."""
    flags = _full(points, options) if options.detect_mode == "full" else _lite(points, options)
    return gated(points, flags).select(*RESULT)


def _lite(points: DataFrame, options: OutlierOptions) -> DataFrame:
    if not options.periods:
        return robust_flags(points)
    rest = season_residuals(row_index(points, total="n"), options.periods)
    return robust_flags(rest.select("series_id", "ts", "value", "y"), "y")


def _full(points: DataFrame, options: OutlierOptions) -> DataFrame:
    """Forest scores with a threshold, or a change point, on what seasons leave.

    Every step reads its rows from a written table: plans stay short, and nothing is computed twice.
    """
    points = written(points)
    spread = points.groupBy("series_id").agg((F.min("value") < F.max("value")).alias("_varies"))
    varied = written(attach(row_index(points, total="n"), spread).where("_varies").drop("_varies"))
    if options.periods:
        rest = season_residuals(varied, options.periods)
    else:
        rest = auto_decompose(varied)
    rest = written(rest.select("series_id", "ts", "rn", "n", "value", "y"))
    delete_written(varied)
    scores = forest_scores(rest, options, value="y")
    scored = written(rest.join(scores.select("series_id", "rn", "score"), ["series_id", "rn"]))
    flags = score_flags(scored.select("series_id", "ts", "rn", "value", "y", "score"), "y")
    shifts = change_points(rest, "y").select("series_id", "rn", F.lit(1).alias("_shift")).distinct()
    both = flags.join(shifts, ["series_id", "rn"], "left").withColumn(
        "anomaly", F.greatest("anomaly", F.coalesce("_shift", F.lit(0)))
    )
    found = both.select("series_id", "ts", F.col("anomaly").alias("_a"))
    return points.join(found, ["series_id", "ts"], "left").withColumn("anomaly", F.coalesce("_a", F.lit(0))).drop("_a")
