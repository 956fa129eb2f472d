"""Queries: files written to the session's shared folder, listed by Spark and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metricwatch.catalog.dynamics import dynamics_sql, run_dynamics
from metricwatch.catalog.prepare import pts
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.catalog.results import WINDOWS, labelled
from metricwatch.catalog.statistics import rounded, rounded_sql
from metricwatch.catalog.streams import scratch
from metricwatch.options import DynamicsOptions
from metricwatch.sources import labels, render


@query("labelled_files", with_ctes("pts", *WINDOWS) + "SELECT series_id, ts, value, label FROM lb")
def labelled_files(spark, folder):
    """Labelled points as CSV in milliseconds, a folder per series, and read again."""
    path = scratch(spark)
    labels.write_labelled_csv(labelled(spark, folder), path)
    return labels.read_labelled_csv(spark, path)


@query(
    "raw_files",
    with_ctes("pts") + "SELECT series_id, ts, value FROM pts WHERE ts % 7 <> 0 AND ts % 11 <> 0",
)
def raw_files(spark, folder):
    """Points as CSV with written dates; rows whose value or date does not parse are left out."""
    path, ts = scratch(spark), F.col("ts")
    text = pts(spark, folder).select(
        "series_id", F.when(ts % 11 == 0, "soon").otherwise(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(ts % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    text.write.partitionBy("series_id").option("header", True).csv(path)
    return labels.read_raw_csv(spark, path)


@query(
    "written_results",
    f"SELECT series_id, ts, value, {rounded_sql(['baseline', 'lower_bound', 'upper_bound'])}, anomaly, TRUE AS in_order FROM ({dynamics_sql('daily', 30, 2.0, 900)})",
)
def written_results(spark, folder):
    """A result table written, read back, and whether each file keeps the order of series and time."""
    path = scratch(spark)
    render.write_results(run_dynamics(spark, folder, DynamicsOptions("daily")), path)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    place = F.struct("series_id", "ts")
    before = F.lag(place).over(Window.partitionBy("file").orderBy("row"))  # one file: at most what one task wrote
    found = rows.withColumn("in_order", F.coalesce(before <= place, F.lit(True)))  # points of one second are not ordered
    return rounded(found, "baseline", "lower_bound", "upper_bound", keep=("series_id", "ts", "value", "anomaly", "in_order"))
