"""Alerts already raised, so that overlapping evaluations raise each of them once.

The table lies under a key, one folder for each day of the alerts and each evaluation. An evaluation
that is run again replaces its own alerts and never sees them, so it raises the same ones again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.sources.store import delete_tables, exists, names_below

DAY = 86_400
SCHEMA = "series_id string, ts long, day long, run string"


def _path(root: str, key: str) -> str:
    return f"{root}/{key}/alerted"


def mark_alerted(root: str, key: str, run: object, flagged: DataFrame) -> None:
    """Note the rows with `anomaly = 1` of `flagged(series_id, ts, anomaly)` as raised by the evaluation `run`."""
    spark = flagged.sparkSession
    # what an earlier attempt of this run left on days that the new one does not reach
    for day in names_below(spark, _path(root, key), "day="):
        delete_tables(spark, f"{_path(root, key)}/{day}", f"run={run}")
    rows = flagged.where(F.col("anomaly") == 1).select("series_id", "ts", F.expr(f"ts div {DAY}").alias("day"), F.lit(str(run)).alias("run"))
    rows.write.partitionBy("day", "run").mode("append").parquet(_path(root, key))


def alerted(spark: SparkSession, root: str, key: str, run: object = None, newest: DataFrame | None = None, lookback_secs: int | None = None) -> DataFrame:
    """`series_id, ts` of all alerts raised by other evaluations than `run`.

    With `newest(series_id, last_seen_ts)`, alerts from before a series' lookback are left out.
    """
    if not names_below(spark, _path(root, key), "day="):
        return spark.createDataFrame([], "series_id string, ts long")
    rows = spark.read.schema(SCHEMA).parquet(_path(root, key)).where(F.col("run") != str(run)).select("series_id", "ts", "day")
    if newest is not None and lookback_secs is not None:
        oldest = newest.agg(F.min("last_seen_ts")).first()[0]
        if oldest is not None:  # prunes whole days
            rows = rows.where(F.col("day") >= (oldest - lookback_secs) // DAY)
        rows = rows.join(newest.select("series_id", "last_seen_ts"), "series_id").where(F.col("ts") >= F.col("last_seen_ts") - lookback_secs)
    return rows.select("series_id", "ts").distinct()


def forget_alerts(spark: SparkSession, root: str, key: str, before: int) -> int:
    """Delete the days that end before the second `before`; the number of days deleted."""
    gone = [d for d in names_below(spark, _path(root, key), "day=") if (int(d[4:]) + 1) * DAY <= before]
    return sum(delete_tables(spark, _path(root, key), d) for d in gone)


def has_alerts(spark: SparkSession, root: str, key: str) -> bool:
    return exists(spark, _path(root, key))
