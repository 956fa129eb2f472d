"""Joins of long tables with per-key values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from metricwatch.session import cut_lineage

SPREAD = 8
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20  # of values, as counted by `value_bytes`
SALT = "_spread"


def salt(points: DataFrame, by: str = "ts", spread: int = SPREAD) -> DataFrame:
    """Add the hash that shares a key's rows among `spread` tasks.

    Several `attach` calls on the same salted table shuffle it once.
    """
    if SALT in points.columns:
        return points
    return points.withColumn(SALT, F.pmod(F.xxhash64(by), F.lit(spread)).cast("int"))


def attach(
    points: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str] = ("series_id",),
    how: str = "left",
    spread_by: str = "ts",
) -> DataFrame:
    """Join one row per key onto many rows per key.

    The small side is repeated SPREAD times and the long side spread by a hash, so a key
    that holds a third of all rows is shared by several tasks. Where the small side turns out
    tiny at run time, the adaptive planner broadcasts it by its measured size.
    """
    keys = list(keys)
    left = salt(points, spread_by)
    right = per_key.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    joined = left.join(right, [*keys, SALT], how)
    return joined if SALT in points.columns else joined.drop(SALT)


def value_bytes(df: DataFrame) -> Column:
    """An aggregate: bytes of all values, eight for a number and the lengths of strings and arrays."""
    total = F.lit(0).cast("long")
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            total = total + F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(field.dataType, ArrayType):
            total = total + 8 * F.greatest(F.size(column), F.lit(0)) + 8
        else:
            total = total + 8
    return F.coalesce(F.sum(total), F.lit(0))


def attach_checked(
    points: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str] = ("series_id",),
    how: str = "left",
    most: int = BROADCAST_ROWS,
    spread_by: str = "ts",
) -> DataFrame:
    """`attach` that leaves the long side where it is when the small side is known to be small.

    The small side is written down once and measured. Up to `most` rows and BROADCAST_BYTES are
    broadcast, so the points go from the scan through the join without a shuffle; beyond that both
    sides are spread.
    """
    return attach_known(points, cut_lineage(per_key), keys, how, most, spread_by)


def attach_known(
    points: DataFrame,
    known: DataFrame,
    keys: Sequence[str] = ("series_id",),
    how: str = "left",
    most: int = BROADCAST_ROWS,
    spread_by: str = "ts",
) -> DataFrame:
    """`attach_checked` with a small side that is written down already."""
    rows, size = known.agg(F.count(F.lit(1)), value_bytes(known)).first()
    if rows <= most and size <= BROADCAST_BYTES:
        return points.join(F.broadcast(known), list(keys), how)
    return attach(points, known, keys, how, spread_by)
