"""Seasonal buckets of epoch seconds. Everything is UTC arithmetic, free of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
HOUR = 3_600
# The slot widths a bucket may have, in seconds.
SLOTS = (60, 300, 600, 900, 1_800, 3_600)
TRENDS = ("monthly", "weekly", "daily", "none")  # coarsening order


def _c(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def day_number(ts: Column) -> Column:
    return F.floor(ts / F.lit(DAY)).cast("int")


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.pmod(day_number(ts) + F.lit(3), F.lit(7))


def day_of_month(ts: Column) -> Column:
    return F.dayofmonth(F.date_from_unix_date(day_number(ts)))


def second_of_day(ts: Column) -> Column:
    return F.pmod(ts, F.lit(DAY))


def snap_slot(step: Column | int) -> Column:
    """Smallest allowed slot that is at least `step`, else one hour."""
    step = _c(step)
    out = F.when(step <= SLOTS[0], F.lit(SLOTS[0]))
    for slot in SLOTS[1:]:
        out = out.when(step <= slot, F.lit(slot))
    return out.otherwise(F.lit(HOUR))


def normalize_slot(slot: Column | int) -> Column:
    slot = _c(slot)
    return F.when(slot == 0, F.lit(HOUR)).otherwise(snap_slot(slot))


def slots_per_day(slot: Column | int) -> Column:
    return F.floor(F.lit(DAY) / _c(slot)).cast("int")


def bucket_count(trend: Column | str, slot: Column | int) -> Column:
    trend, spd = _c(trend), slots_per_day(slot)
    return (
        F.when(trend == "daily", spd)
        .when(trend == "weekly", spd * 7)
        .when(trend == "monthly", spd * 31)
        .otherwise(F.lit(1))
    )


def season_key(ts: Column, trend: Column | str, slot: Column | int = HOUR) -> Column:
    """Bucket number of a time within its day, week or month."""
    trend, spd = _c(trend), slots_per_day(slot)
    in_day = F.floor(second_of_day(ts) / _c(slot)).cast("int")
    return (
        F.when(trend == "daily", in_day)
        .when(trend == "weekly", weekday(ts) * spd + in_day)
        .when(trend == "monthly", (day_of_month(ts) - 1) * spd + in_day)
        .otherwise(F.lit(0))
    ).cast("int")


def previous_bucket(key: Column, count: Column | int) -> Column:
    return F.pmod(key - 1, _c(count))


def next_bucket(key: Column, count: Column | int) -> Column:
    return F.pmod(key + 1, _c(count))


def coarser_slot(slot: Column | int) -> Column:
    """Next wider allowed slot, NULL at one hour."""
    slot = normalize_slot(slot)
    out = F.when(slot == SLOTS[0], F.lit(SLOTS[1]))
    for here, there in zip(SLOTS[1:], SLOTS[2:]):
        out = out.when(slot == here, F.lit(there))
    return out


def coarser_trend(trend: Column | str) -> Column:
    trend = _c(trend)
    return (
        F.when(trend == "monthly", F.lit("weekly"))
        .when(trend == "weekly", F.lit("daily"))
        .otherwise(F.lit("none"))
    )


def blend_weights(ts: Column, slot: Column | int, transition: Column | int) -> tuple[Column, Column]:
    """Weights of the previous and the next bucket; the current one has the rest.

    At a slot edge both neighbours count half; `transition` seconds away from it only the
    bucket itself counts. The transition never exceeds half a slot.
    """
    slot = _c(slot)
    t = F.least(_c(transition), F.floor(slot / F.lit(2))).cast("double")
    s = F.pmod(second_of_day(ts), slot).cast("double")
    on = t > 0
    w_prev = F.when(on & (s < t), F.lit(0.5) - F.lit(0.5) * s / t).otherwise(F.lit(0.0))
    w_next = F.when(
        on & (s >= t) & (s > slot - t), F.lit(0.5) * ((s - (slot - t)) / t)
    ).otherwise(F.lit(0.0))
    return w_prev, w_next


def interval_end_minute(ts: Column, interval: Column | int) -> Column:
    """Minute closing the interval a time falls in; minute 0 belongs to the first, 60 is the cap."""
    interval = _c(interval)
    minute = F.floor(F.pmod(ts, F.lit(HOUR)) / F.lit(60)).cast("int")
    up = (F.ceil(minute / interval) * interval).cast("int")
    return F.least(F.when(minute == 0, interval).otherwise(up), F.lit(60)).cast("int")
