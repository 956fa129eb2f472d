"""Seasonal profiles: slot and trend choice, samples per bucket, upkeep.

A profile is two tables. `meta` has one row per series: requested and effective trend, slot
width, newest time seen. `samples` has `series_id, bucket, ts, value`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.functions import season
from metricwatch.operators import aggregates
from metricwatch.operators.joins import attach, attach_checked
from metricwatch.operators.ordered import rolling, row_index
from metricwatch.operators.quantiles import exact_quantiles
from metricwatch.operators.robust_buckets import keep_ranges
from metricwatch.options import FunnelOptions
from metricwatch.session import cut_lineage

META = ("series_id", "trend", "effective_trend", "slot_secs", "last_seen_ts")
SAMPLES = ("series_id", "bucket", "ts", "value")


def series_of(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )


def infer_slots(points: DataFrame) -> DataFrame:
    """Slot width per series from the upper median gap between neighbouring points."""
    gaps = rolling(row_index(points), {"gap": lambda w: F.col("ts") - F.lag("ts").over(w)}, back=1)
    # Half-way between two gaps "nearest" takes the upper one.
    middle = exact_quantiles(gaps.where(F.col("gap") > 0), ["series_id"], "gap", {"median": 0.5}, "nearest")
    slot = season.snap_slot(F.greatest(F.round("median"), F.lit(1)))
    return series_of(points).join(middle.select("series_id", slot.alias("slot")), "series_id", "left").select(
        "series_id", F.coalesce("slot", F.lit(season.HOUR)).cast("int").alias("slot")
    )


def trend_rule(span_days: Column, hour: Column, week: Column, strength: Column) -> Column:
    """Granularity from the history's span and its seasonal effects. The numbers are fixed values."""
    flat = (hour < 0.05) & (week < 0.05) & (strength < 0.05)
    weekly = (span_days >= 14) & (week > F.greatest(hour, F.lit(0.08))) & (week > 0.10)
    monthly = (span_days >= 180) & (strength > 0.2) & (week > hour)
    return (
        F.when(span_days < 2, "none").when(flat, "none").when(weekly, "weekly").when(monthly, "monthly")
        .when((hour >= 0.05) | (strength >= 0.05), "daily")
        .when(span_days >= 14, "weekly").otherwise("daily")
    )


def infer_trends(points: DataFrame) -> DataFrame:
    """Trend granularity per series, with the effects it rests on."""
    span = series_of(points).withColumn("span_days", (F.col("last_ts") - F.col("first_ts")) / F.lit(86_400.0))
    rule = trend_rule(F.col("span_days"), F.col("hour_effect"), F.col("weekday_effect"), F.col("day_strength"))
    return (
        span.join(aggregates.hour_effect(points), "series_id")
        .join(aggregates.weekday_effect(points), "series_id")
        .join(aggregates.day_mate_strength(points).drop("pairs"), "series_id")
        .select("series_id", "span_days", "hour_effect", "weekday_effect", "day_strength", rule.alias("trend"))
    )


def attempts(wanted: DataFrame) -> DataFrame:
    """Ranked (trend, slot) attempts per series: slots from the base to an hour, then coarser trends.

    `wanted` has `series_id, trend, slot`; a series gets at most 19 attempts.
    """
    ladder = [
        F.struct(
            F.lit(t * len(season.SLOTS) + s).alias("rank"),
            F.lit(trend).alias("effective_trend"), F.lit(slot).alias("slot_secs"), F.lit(t).alias("level"),
        )
        for t, trend in enumerate(season.TRENDS) for s, slot in enumerate(season.SLOTS)
    ]
    level = F.array_position(F.array(*[F.lit(t) for t in season.TRENDS]), F.col("trend")) - 1
    wide = wanted.withColumn("_level", level).withColumn("_a", F.explode(F.array(*ladder)))
    fits = (F.col("_a.level") >= F.col("_level")) & (F.col("_a.slot_secs") >= F.col("slot"))
    # Without a trend there is one bucket, whatever the slot: only the base slot is tried.
    once = (F.col("_a.effective_trend") != "none") | (F.col("_a.slot_secs") == F.col("slot"))
    return wide.where(fits & once).select("series_id", "trend", "_a.rank", "_a.effective_trend", "_a.slot_secs")


def choose_buckets(points: DataFrame, wanted: DataFrame, options: FunnelOptions) -> DataFrame:
    """Profile meta: per series the first attempt whose share of sparse buckets is acceptable.

    Points are first counted per minute (the finest slot), so all attempts together read a
    small table in one aggregation.
    """
    ends = series_of(points).select("series_id", F.col("last_ts").alias("last_seen_ts"))
    minute = (F.floor(F.col("ts") / season.SLOTS[0]) * season.SLOTS[0]).cast("long")
    recent = attach(points.where(F.col("value").isNotNull()), ends).where(
        F.col("ts") >= F.col("last_seen_ts") - options.lookback_secs
    )
    minutes = recent.groupBy("series_id", minute.alias("ts")).agg(F.count(F.lit(1)).alias("c"))
    tried = attempts(wanted)
    key = season.season_key(F.col("ts"), F.col("effective_trend"), F.col("slot_secs"))
    per_series = tried.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "trend", "effective_trend", "slot_secs"))).alias("_tried")
    )
    cells = (
        attach(minutes, per_series, how="inner")
        .select("series_id", "ts", "c", F.explode("_tried").alias("a"))
        .select("series_id", "ts", "c", "a.*")
        .groupBy("series_id", "rank", "trend", "effective_trend", "slot_secs", key.alias("bucket"))
        .agg(F.sum("c").alias("count"))
    )
    buckets = season.bucket_count(F.col("effective_trend"), F.col("slot_secs"))
    rated = cells.groupBy("series_id", "rank", "trend", "effective_trend", "slot_secs").agg(
        (F.lit(1.0) - F.count_if(F.col("count") >= options.min_samples) / F.max(buckets)).alias("sparse_ratio")
    )
    passing = rated.where(
        (F.col("sparse_ratio") <= options.max_sparse_bucket_ratio) | (F.col("effective_trend") == "none")
    )
    best = passing.groupBy("series_id").agg(
        F.min_by(F.struct("trend", "effective_trend", "slot_secs", "sparse_ratio"), "rank").alias("_best")
    )
    return best.join(ends, "series_id").select("series_id", "_best.*", "last_seen_ts")


def wanted_buckets(points: DataFrame, options: FunnelOptions) -> DataFrame:
    """Requested trend and base slot per series: from the options, else inferred."""
    if options.bucket_slot_secs:
        wanted = series_of(points).select("series_id", F.lit(options.bucket_slot_secs).alias("slot"))
    else:
        wanted = infer_slots(points)
    if options.trend or not options.auto_trend:
        return wanted.withColumn("trend", F.lit(options.trend or "daily"))
    return wanted.join(infer_trends(points).select("series_id", "trend"), "series_id")


def build_profile(points: DataFrame, options: FunnelOptions = FunnelOptions()) -> tuple[DataFrame, DataFrame]:
    """`(meta, samples)` of a history, with obvious outliers scrubbed from the buckets."""
    # One row per series, read by every later step: written down once.
    meta = cut_lineage(choose_buckets(points, wanted_buckets(points, options), options).select(*META))
    return meta, purge(place(points, meta, options), options)


def place(points: DataFrame, meta: DataFrame, options: FunnelOptions) -> DataFrame:
    """Points of the lookback window with their bucket."""
    key = season.season_key(F.col("ts"), F.col("effective_trend"), F.col("slot_secs"))
    return (
        attach_checked(
            points.where(F.col("value").isNotNull()),
            meta.select("series_id", "effective_trend", "slot_secs", "last_seen_ts"), how="inner",
        )
        .where(F.col("ts") >= F.col("last_seen_ts") - options.lookback_secs)
        .withColumn("bucket", key).select(*SAMPLES)
    )


def purge(samples: DataFrame, options: FunnelOptions) -> DataFrame:
    """Drop samples outside the range that scrubbing leaves of their bucket."""
    ranges = keep_ranges(samples, options.hampel_k, options.min_samples)
    inside = (F.col("value") >= F.col("keep_from")) & (F.col("value") <= F.col("keep_to"))
    return attach(samples, ranges, ["series_id", "bucket"], "inner").where(inside).select(*SAMPLES)


def without_points(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Samples whose (series, time) does not occur in `points`."""
    return samples.join(points.select("series_id", "ts"), ["series_id", "ts"], "left_anti").select(*samples.columns)


def upsert(samples: DataFrame, batch: DataFrame) -> DataFrame:
    """Union by (series, time); the batch's value wins. Ingesting a batch twice changes nothing."""
    both = samples.select("series_id", "ts", "value", F.lit(0).alias("_batch")).unionByName(
        batch.where(F.col("value").isNotNull()).select("series_id", "ts", "value", F.lit(1).alias("_batch"))
    )
    return both.groupBy("series_id", "ts").agg(F.max_by("value", "_batch").alias("value"))


def evict(points: DataFrame, newest: DataFrame, lookback_secs: int) -> DataFrame:
    """Rows not older than `lookback_secs` before the series' `last_seen_ts`."""
    kept = attach(points, newest.select("series_id", "last_seen_ts"), how="inner")
    return kept.where(F.col("ts") >= F.col("last_seen_ts") - lookback_secs).select(*points.columns)


def refresh_profile(
    meta: DataFrame,
    samples: DataFrame,
    batch: DataFrame,
    anomalies: DataFrame,
    options: FunnelOptions = FunnelOptions(),
) -> tuple[DataFrame, DataFrame]:
    """Take a scored batch into the profile: upsert, evict, leave out anomalies, scrub."""
    newest = batch.groupBy("series_id").agg(F.max("ts").alias("_newest"))
    moved = meta.join(newest, "series_id", "left").withColumn(
        "last_seen_ts", F.greatest("last_seen_ts", "_newest")
    ).select(*META)
    merged = without_points(upsert(samples, batch), anomalies)
    return moved, purge(place(merged, moved, options), options)
