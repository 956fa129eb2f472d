"""Calendar features of a time, as used by the forecast."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricwatch.functions import season

FEATURES = (
    "hour_norm", "dow_norm", "dom_norm", "month_norm", "quarter_norm", "is_weekend",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "dom_sin", "dom_cos",
)


def _circle(x: Column, period: int) -> tuple[Column, Column]:
    angle = x * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def calendar_features(ts: Column) -> list[Column]:
    """The fourteen columns of FEATURES for an epoch-second column."""
    date = F.date_from_unix_date(season.day_number(ts))
    hour = F.floor(season.second_of_day(ts) / F.lit(3600)).cast("double")
    dow = season.weekday(ts).cast("double")
    dom = (F.dayofmonth(date) - 1).cast("double")
    month = (F.month(date) - 1).cast("double")
    quarter = (F.quarter(date) - 1).cast("double")
    values = [
        hour / 23.0, dow / 6.0, dom / 30.0, month / 11.0, quarter / 3.0,
        (dow >= 5).cast("double"),
        *_circle(hour, 24), *_circle(dow, 7), *_circle(month, 12), *_circle(dom, 31),
    ]
    return [value.alias(name) for name, value in zip(FEATURES, values)]
