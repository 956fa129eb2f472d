"""The canonical points table: `series_id STRING, ts BIGINT (epoch seconds), value DOUBLE`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricwatch.functions.numeric import finite

# Column names recognised as time and value, most specific first.
TIME_NAMES = ("time", "timestamp", "ts", "__timestamp")
VALUE_NAMES = ("value", "__value")


def ntz_seconds(c: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, whatever the session zone is."""
    return (
        F.unix_date(c.cast("date")).cast("long") * 86_400
        + F.hour(c) * 3_600 + F.minute(c) * 60 + F.second(c)
    )


def epoch_seconds(c: Column, data_type: T.DataType | None = None) -> Column:
    """Epoch seconds from a timestamp, or from a number in seconds, milli- or nanoseconds."""
    if isinstance(data_type, T.TimestampNTZType):
        return ntz_seconds(c)
    if isinstance(data_type, (T.TimestampType, T.DateType)):
        return F.unix_seconds(c.cast("timestamp"))
    x = c.try_cast("double")
    size = F.abs(x)
    return F.when(size >= 1e15, x / 1e9).when(size >= 1e11, x / 1e3).otherwise(x)


def _pick(df: DataFrame, names: Sequence[str], fallback) -> str:
    by_lower = {f.name.lower(): f.name for f in df.schema.fields}
    for name in names:
        if name in by_lower:
            return by_lower[name]
    return fallback(df)


def _first_time(df: DataFrame) -> str:
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
    return df.schema.fields[0].name


def points_from_table(
    df: DataFrame,
    series: Column | str,
    time: str | None = None,
    value: str | None = None,
    null_as_zero: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Points of an arbitrary table: time and value by name, else the first of a fitting type."""
    time = time or _pick(df, TIME_NAMES, _first_time)

    def first_numeric(frame: DataFrame) -> str:
        for f in frame.schema.fields:
            if f.name != time and isinstance(f.dataType, T.NumericType):
                return f.name
        raise ValueError("no numeric column")

    value = value or _pick(df, VALUE_NAMES, first_numeric)
    v = finite(F.col(value).try_cast("double"))
    if null_as_zero:
        v = F.coalesce(v, F.lit(0.0))
    ts = F.floor(epoch_seconds(F.col(time), df.schema[time].dataType)).cast("long")
    return df.select(
        (F.col(series) if isinstance(series, str) else series).cast("string").alias("series_id"),
        ts.alias("ts"), v.alias("value"), *keep,
    )


def canonical(points: DataFrame, version: str = "event_id") -> DataFrame:
    """One value per (series, second): the highest `version` wins. Combines before shuffling."""
    return points.groupBy("series_id", "ts").agg(F.max_by("value", version).alias("value"))


def read_events(
    spark: SparkSession,
    folder: str,
    start: str | None = None,
    end: str | None = None,
    series: Column | str = "event_type",
) -> DataFrame:
    """Raw points of `events` with their event id. Time bounds are zone-less timestamp literals on
    the stored column, so they reach the Parquet scan."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    if start:
        events = events.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{start}'"))
    if end:
        events = events.where(F.col("ts") < F.expr(f"TIMESTAMP_NTZ'{end}'"))
    return points_from_table(events, series, "ts", "value", keep=("event_id",))


def read_daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Daily order totals per priority, in whole cents so that sums do not depend on their order."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return (
        orders.groupBy(
            F.col("o_orderpriority").alias("series_id"),
            (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400).alias("ts"),
        )
        .agg((cents / F.lit(100.0)).alias("value"))
    )
