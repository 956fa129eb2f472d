"""Streams of points: resampling, duplicates, incidents, and alerts that are raised once.

A stream has `series_id, event_time TIMESTAMP, ts BIGINT, value`. State is kept by Spark in its
checkpoint and ends with the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.sources.points import ntz_seconds


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Points of `events` files as they arrive in a folder."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    ts = ntz_seconds(F.col("ts"))
    return reader.parquet(folder).select(
        F.col("event_type").alias("series_id"), F.timestamp_seconds(ts).alias("event_time"), ts.alias("ts"),
        "value", "event_id",
    )


def resample_stream(stream: DataFrame, step: int, lateness: int, slide: int | None = None) -> DataFrame:
    """Mean, largest value and count per series and window; each window once, when it is complete."""
    window = F.window("event_time", f"{step} seconds", f"{slide} seconds" if slide else None)
    return (
        stream.withWatermark("event_time", f"{lateness} seconds").groupBy("series_id", window)
        .agg(F.avg("value").alias("value"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("points"))
        .select("series_id", F.unix_seconds("window.start").alias("ts"), "value", "peak", "points")
    )


def first_of_each_second(stream: DataFrame, lateness: int) -> DataFrame:
    """Each (series, second) once; repeats within `lateness` and later rows are dropped."""
    return stream.withWatermark("event_time", f"{lateness} seconds").dropDuplicatesWithinWatermark(["series_id", "ts"])


def canonical_stream(stream: DataFrame, lateness: int) -> DataFrame:
    """Each (series, second) once with the value of its largest `event_id`, as `sources.points.canonical` has it.

    A second comes out when the watermark has passed it; later rows are dropped.
    """
    return (
        stream.withWatermark("event_time", f"{lateness} seconds").groupBy("series_id", F.window("event_time", "1 second"))
        .agg(F.max_by("value", "event_id").alias("value")).select("series_id", F.unix_seconds("window.start").alias("ts"), "value")
    )


def incident_stream(flagged: DataFrame, gap: int, lateness: int) -> DataFrame:
    """Sessions of anomalies closer than `gap` seconds; each once, when it is over."""
    session = F.session_window("event_time", f"{gap} seconds")
    return (
        flagged.where(F.col("anomaly") == 1).withWatermark("event_time", f"{lateness} seconds")
        .groupBy("series_id", session).agg(F.count(F.lit(1)).alias("points"), F.max("value").alias("peak"))
        .select("series_id", F.unix_seconds("session_window.start").alias("start_ts"),
                (F.unix_seconds("session_window.end") - gap).alias("end_ts"), "points", "peak")
    )


def with_end_marks(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and whatever `mark_end` writes to `folder`; to be used before a watermark is set."""
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(folder))


def mark_end(stream: DataFrame, folder: str, at: int, **values: object) -> None:
    """Say that nothing before second `at` will come any more.

    The mark is one row of no series, known in `event_time`, `ts` and `values` only. It moves the
    watermark to `at` less the lateness, so windows and sessions that end before come out; its own
    stays open. `at` is the last event plus the window or gap and the lateness, plus one. Events later
    than the watermark go on as before.
    """
    known = {"event_time": F.timestamp_seconds(F.lit(at)), "ts": F.lit(at), **{k: F.lit(v) for k, v in values.items()}}
    row = stream.sparkSession.range(1, numPartitions=1)
    row.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]).write.mode("append").parquet(folder)


def new_alerts(flagged: DataFrame, remember: int) -> DataFrame:
    """Each anomalous (series, time) once within `remember` seconds, however often it is evaluated."""
    return first_of_each_second(flagged.where(F.col("anomaly") == 1), remember)
