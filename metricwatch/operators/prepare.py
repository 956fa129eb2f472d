"""Slicing, resampling, gating and gap filling of points, for all series at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import known_neighbours, row_index
from metricwatch.session import cut_lineage

COLD_START_ROWS = 20
COLD_START_SHARE = 0.7
DEFAULT_POINT_BUDGET = 1_500
DEFAULT_HISTORY_SECS = 7 * 86_400
NAMED_SERIES = 1_000  # series without a stored range up to which their names are pushed to the scan


def time_slice(points: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open slice [start, end)."""
    return points.where((F.col("ts") >= start) & (F.col("ts") < end))


def extend_back(points: DataFrame, start: int, end: int, history_secs: int = DEFAULT_HISTORY_SECS) -> DataFrame:
    """The panel range [start, end) with `history_secs` before it, and a role per row."""
    kept = time_slice(points, start - history_secs, end)
    return kept.withColumn("role", F.when(F.col("ts") < start, "history").otherwise("current"))


def cold_start_cut(n: Column) -> Column:
    """Rows that become history when there is no time boundary to split at."""
    share = F.least(F.greatest(F.floor(n * COLD_START_SHARE), F.lit(1)), n - 1)
    return F.when(n < 2, F.lit(None)).when(n < COLD_START_ROWS, F.floor(n / 2)).otherwise(share).cast("long")


def tail_cut(n: Column) -> Column:
    """Rows that stay history when the evaluation has to use the tail of history."""
    share = F.least(F.greatest(F.floor(n * COLD_START_SHARE), F.lit(1)), n - 1)
    return F.when(n < 2, F.lit(None)).otherwise(share).cast("long")


def cold_start_split(points: DataFrame) -> DataFrame:
    """Split each series by position; a series of one point has no role."""
    indexed = row_index(points, total="n")
    cut = cold_start_cut(F.col("n"))
    return indexed.withColumn(
        "role", F.when(F.col("rn") < cut, "history").when(F.col("rn") >= cut, "current")
    )


def ensure_roles(points: DataFrame) -> DataFrame:
    """Make sure every series has history and current points.

    `role` may leave a series one-sided: only current points are split like a cold start, only
    history points give their tail to the evaluation.
    """
    counts = points.groupBy("series_id").agg(
        F.count_if(F.col("role") == "history").alias("_h"),
        F.count_if(F.col("role") == "current").alias("_c"),
    )
    indexed = attach(row_index(points, total="n"), counts)
    both = (F.col("_h") > 0) & (F.col("_c") > 0)
    cut = F.when(F.col("_h") > 0, tail_cut(F.col("n"))).otherwise(cold_start_cut(F.col("n")))
    role = F.when(both, F.col("role")).when(F.col("rn") < cut, "history").when(F.col("rn") >= cut, "current")
    return indexed.withColumn("role", role).drop("_h", "_c", "rn", "n")


def eval_window(points: DataFrame, secs: int) -> DataFrame:
    """Add `in_eval`: the trailing `secs` seconds of each series, everything when 0."""
    if secs == 0:
        return points.withColumn("in_eval", F.lit(True))
    last = points.groupBy("series_id").agg(F.max("ts").alias("_last"))
    return attach(points, last).withColumn("in_eval", F.col("ts") >= F.col("_last") - secs).drop("_last")


def step_for(panel_step: int, span: int, max_points: int = DEFAULT_POINT_BUDGET, fixed_step: int = 0) -> int:
    """Resampling step: a fixed one wins, else the panel's, coarsened to the point budget."""
    if fixed_step > 0:
        return fixed_step
    return max(panel_step, span // max_points) if panel_step > 0 and span > 0 else panel_step


def points_needed(span: Column, step: Column, panel_points: int = 1) -> Column:
    """Points that cover `span` at `step`."""
    needed = F.ceil(F.greatest(span, F.lit(0)) / step)
    return F.greatest(needed, F.lit(panel_points), F.lit(1))


def resample(points: DataFrame, step: int, how: str = "avg") -> DataFrame:
    """One point per `step` seconds and series; combines before the shuffle."""
    agg = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]
    slot = (F.floor(F.col("ts") / step) * step).cast("long")
    return points.groupBy("series_id", slot.alias("ts")).agg(agg("value").alias("value"))


def regular_grid(points: DataFrame, step: int) -> DataFrame:
    """Every step between a series' first and last one; steps without a point get NULL."""
    span = points.groupBy("series_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    # Stretches first, then the steps within: no array grows with the length of a series.
    stretch = F.lit(step * 4_096).cast("long")
    starts = span.withColumn("_s", F.explode(F.sequence(F.col("_a"), F.col("_b"), stretch)))
    last = F.least(F.col("_s") + stretch - step, F.col("_b"))
    slots = F.sequence(F.col("_s"), last, F.lit(step).cast("long"))
    return starts.select("series_id", F.explode(slots).alias("ts")).join(points, ["series_id", "ts"], "left")


def gap_plan(cached_from: Column, cached_to: Column, want_from: Column, want_to: Column) -> Column:
    """What must be fetched when a stored range exists: cover, extend_*, or miss."""
    apart = (
        (want_to <= want_from) | (cached_to <= cached_from)
        | (want_to <= cached_from) | (want_from >= cached_to)
    )
    left, right = want_from < cached_from, want_to > cached_to
    return (
        F.when(cached_from.isNull() | apart, "miss")
        .when(left & right, "extend_both").when(left, "extend_left").when(right, "extend_right")
        .otherwise("cover")
    )


def extend_history(stored: DataFrame, source: DataFrame, start: int, end: int, series: DataFrame | None = None) -> DataFrame:
    """Points of [start, end): stored ones where the stored range covers it, only gaps from source.

    The stored range of a series is half-open, up to one second past its last point. What is read of
    the source is known before it is read, so that the bounds reach its scan: no more than the time
    before the latest start and after the earliest end of the stored ranges, and all of [start, end)
    for the series that have no range in it, by name where these are few. `series` lists the
    `series_id`s asked for and limits the result to them; without it all of both tables are asked
    for, which reads the `series_id` column of the source once more. Points of no series are left
    out, points without a time are in no range.
    """
    if series is not None:
        names = series.select("series_id").where(F.col("series_id").isNotNull()).distinct()
        stored = stored.join(names, "series_id", "left_semi").select(*stored.columns)
    else:
        names = source.select("series_id").where(F.col("series_id").isNotNull()).distinct()
    stored = stored.where(F.col("series_id").isNotNull())
    span = stored.groupBy("series_id").agg(F.min("ts").alias("_from"), (F.max("ts") + 1).alias("_to"))
    plan = gap_plan(F.col("_from"), F.col("_to"), F.lit(start), F.lit(end))
    plans = cut_lineage(names.join(span, "series_id", "left").select("series_id", "_from", "_to", plan.alias("_plan")))
    held = F.col("_plan") != "miss"
    latest, earliest, missed = plans.agg(F.max(F.when(held, F.col("_from"))), F.min(F.when(held, F.col("_to"))), F.count_if(~held)).first()
    parts = [time_slice(stored, start, end)]
    if latest is not None and latest > start:
        before = attach(time_slice(source, start, min(latest, end)), plans.where(held), how="inner")
        parts.append(before.where(F.col("ts") < F.col("_from")).select(*stored.columns))
    if earliest is not None and earliest < end:
        after = attach(time_slice(source, max(earliest, start), end), plans.where(held), how="inner")
        parts.append(after.where(F.col("ts") >= F.col("_to")).select(*stored.columns))
    if missed:
        rows, absent = time_slice(source, start, end), plans.where(~held).select("series_id")
        if missed <= NAMED_SERIES:
            rows = rows.where(F.col("series_id").isin([r[0] for r in absent.collect()]))
        else:
            rows = rows.join(absent, "series_id", "left_semi")
        parts.append(rows.select(*stored.columns))
    return reduce(DataFrame.unionByName, parts)


def missing_gate(points: DataFrame, missing: float = 0.3, zeros: float = 0.3) -> DataFrame:
    """Per series: shares of missing and zero values and the gate they lead to."""
    unknown = F.col("value").isNull() | F.isnan("value")
    infinite = F.abs("value") == float("inf")
    return points.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(unknown).alias("missing"),
        F.avg(unknown.cast("double")).alias("missing_rate"),
        F.avg((unknown | infinite).cast("double")).alias("bad_rate"),
        F.avg((F.coalesce("value", F.lit(0.0)) == 0).cast("double")).alias("zero_rate"),
        (F.min("value") == F.max("value")).alias("constant"),
    ).withColumn(
        "gate",
        F.when(F.col("missing_rate") > missing, "missing")
        .when(F.col("zero_rate") > zeros, "zeros")
        .when(F.coalesce("constant", F.lit(False)), "constant")
        .otherwise("ok"),
    )


def interpolate_gaps(indexed: DataFrame) -> DataFrame:
    """Fill inner gaps linearly over row positions; leading and trailing gaps stay."""
    near = known_neighbours(indexed)
    x0, x1 = F.col("before.at"), F.col("after.at")
    v0, v1 = F.col("before.v"), F.col("after.v")
    between = v0 + (v1 - v0) / (x1 - x0) * (F.col("rn") - x0)
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(x1 > x0, between)
    return near.withColumn("filled", filled).drop("before", "after")


def forward_fill(indexed: DataFrame) -> DataFrame:
    """Repeat the last known value; leading gaps stay."""
    return known_neighbours(indexed).withColumn("filled", F.col("before.v")).drop("before", "after")


def every_kth(indexed: DataFrame, k: int) -> DataFrame:
    return indexed.where(F.pmod("rn", F.lit(k)) == 0)


def shift_to(points: DataFrame, as_of: str) -> DataFrame:
    """Move all times by whole days so that the newest day becomes `as_of`."""
    newest = points.agg(F.floor(F.max("ts") / 86_400).alias("day")).scalar()
    target = F.unix_date(F.to_date(F.lit(as_of))).cast("long")
    return points.withColumn("ts", F.col("ts") + (target - newest) * 86_400)
