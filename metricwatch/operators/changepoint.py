"""Mean-shift change points by binary segmentation on running sums.

A round finds the best split of every open segment of every series in one aggregation; splits
whose gain beats the penalty open two segments. Rounds go on until nothing splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import running_sum
from metricwatch.session import cut_lineage, delete_written, written

MIN_SEGMENT = 5


def prepare_segments(indexed: DataFrame, value: str = "value") -> DataFrame:
    """Rows with the sum before them, their segment (all in one) and the series' penalty.

    Values are taken from the series' mean first: gains are differences of squared sums, which a high
    level would drown. A missing value counts as the mean.
    """
    stats = indexed.groupBy("series_id").agg(
        F.count(value).alias("_n"), F.var_pop(value).alias("_var"), F.avg(value).alias("_mean")
    ).select("series_id", (F.lit(2.0) * F.col("_var") * F.ln("_n")).alias("penalty"), "_mean")
    level = F.coalesce(F.col(value) - F.col("_mean"), F.lit(0.0))
    centred = attach(indexed, stats).select("series_id", "ts", "rn", level.alias("v"), "penalty")
    summed = running_sum(centred, {"_sum": "v"})
    return summed.withColumn("before", F.col("_sum") - F.col("v")).drop("_sum").withColumn("segment", F.lit("1"))


def best_splits(rows: DataFrame, min_segment: int = MIN_SEGMENT) -> DataFrame:
    """`series_id, segment, split, gain`: the split that lowers squared error most, if worth it."""
    cells = rows.groupBy("series_id", "segment").agg(
        F.min("rn").alias("a"), F.max("rn").alias("b"), F.min_by("before", "rn").alias("base"), F.sum("v").alias("total")
    )
    left, right = F.col("rn") - F.col("a"), F.col("b") - F.col("rn") + 1
    part = F.col("before") - F.col("base")
    rest = F.col("total") - part
    gain = part * part / left + rest * rest / right - F.col("total") * F.col("total") / (left + right)
    tried = attach(rows, cells, ["series_id", "segment"], "inner", "rn").where(
        (left >= min_segment) & (right >= min_segment)
    ).withColumn("gain", gain)
    best = tried.groupBy("series_id", "segment").agg(
        F.max(F.struct("gain", (-F.col("rn")).alias("at"))).alias("_best"), F.first("penalty").alias("penalty")
    )
    return best.where(F.col("_best.gain") > F.col("penalty")).select(
        "series_id", "segment", (-F.col("_best.at")).alias("split"), F.col("_best.gain").alias("gain")
    )


def change_points(indexed: DataFrame, value: str = "value", max_rounds: int | None = None) -> DataFrame:
    """`series_id, rn, gain` of every first row after a mean shift."""
    rows = written(prepare_segments(indexed, value))
    found, rounds = None, 0
    while max_rounds is None or rounds < max_rounds:
        splits = cut_lineage(best_splits(rows))
        rounds += 1
        if found is not None and splits.isEmpty():
            break
        found = splits if found is None else found.unionByName(splits)
        half = F.when(F.col("rn") < F.col("split"), "0").otherwise("1")
        # Only segments that split can split again.
        done, rows = rows, attach(rows, splits.select("series_id", "segment", "split"), ["series_id", "segment"], "inner", "rn")
        rows = written(rows.withColumn("segment", F.concat("segment", half)).drop("split"))
        delete_written(done)
    return found.select("series_id", F.col("split").alias("rn"), "gain")
