"""Ordered operators that never need a whole series in one task.

A plain window over a series puts the series into one task, however long it is. Here every
row first gets its exact position in its series (counted per stretch of time, then offset),
and positions are cut into blocks of equal size. A bounded frame only needs its block plus a
halo of neighbouring rows; an unbounded frame needs its block plus one summary row per block.

Points are unique by (series, second) (`sources.points.canonical`), so a stretch of
CHUNK_SECS seconds holds at most that many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("series_id",)
CHUNK_SECS = 1 << 20
BLOCK_ROWS = 1 << 16


def row_index(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = "ts",
    chunk: Column | None = None,
    out: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series, and optionally the series length.

    `chunk` must grow with `order`; rows that share it are numbered within one task.
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / CHUNK_SECS) if chunk is None else chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")]
    if total:
        offsets.append(F.sum("_size").over(Window.partitionBy(*keys)).alias(total))
    offsets = sizes.select(*keys, "_chunk", *offsets)
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    return (
        chunked.withColumn("_local", local)
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_local") - 1).cast("long"))
        .drop("_chunk", "_local", "_before")
    )


def with_halo(
    df: DataFrame,
    back: int = 0,
    ahead: int = 0,
    index: str = "rn",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Give each row its block, and copy edge rows into the neighbouring block (`_home` differs)."""
    if max(back, ahead) > block_rows:
        raise ValueError("the frame is wider than a block")
    home = F.floor(F.col(index) / block_rows)
    pos = F.pmod(F.col(index), F.lit(block_rows))
    targets = [F.col("_home")]
    if back:
        targets.append(F.when(pos >= block_rows - back, F.col("_home") + 1))
    if ahead:
        targets.append(F.when((pos < ahead) & (F.col("_home") > 0), F.col("_home") - 1))
    return df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.array_compact(F.array(*targets)))
    )


def rolling(
    df: DataFrame,
    columns: dict[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    index: str = "rn",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add bounded window columns; each function gets the block's window ordered by position."""
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    wide = with_halo(df, back, ahead, index, block_rows)
    for name, fn in columns.items():
        wide = wide.withColumn(name, fn(window))
    return wide.where(F.col("_block") == F.col("_home")).drop("_block", "_home")


def running_sum(
    df: DataFrame,
    values: dict[str, Column | str],
    keys: Sequence[str] = KEYS,
    index: str = "rn",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add inclusive running sums over the whole series."""
    keys = list(keys)
    blocks = df.withColumn("_block", F.floor(F.col(index) / block_rows))
    named = {out: F.col(v) if isinstance(v, str) else v for out, v in values.items()}
    totals = blocks.groupBy(*keys, "_block").agg(
        *[F.sum(v).alias(f"_t_{out}") for out, v in named.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block", *[F.sum(f"_t_{out}").over(before).alias(f"_o_{out}") for out in named]
    )
    local = (
        Window.partitionBy(*keys, "_block").orderBy(index)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = blocks
    for out, v in named.items():
        summed = summed.withColumn(f"_s_{out}", F.sum(v).over(local))
    summed = summed.join(offsets, [*keys, "_block"])
    for out in named:
        summed = summed.withColumn(out, F.col(f"_s_{out}") + F.coalesce(F.col(f"_o_{out}"), F.lit(0)))
    return summed.drop("_block", *[f"_{a}_{out}" for out in named for a in "so"])


def known_neighbours(
    df: DataFrame,
    value: str = "value",
    keys: Sequence[str] = KEYS,
    index: str = "rn",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add `before` and `after`: position and value of the nearest known rows on each side.

    A row that has a value is its own neighbour on both sides.
    """
    keys = list(keys)
    mark = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("at"), F.col(value).alias("v")))
    blocks = df.withColumn("_block", F.floor(F.col(index) / block_rows)).withColumn("_mark", mark)
    ends = blocks.groupBy(*keys, "_block").agg(
        F.max("_mark").alias("_last"), F.min("_mark").alias("_first")
    )
    by_block = Window.partitionBy(*keys).orderBy("_block")
    carried = ends.select(
        *keys,
        "_block",
        F.last("_last", True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
        F.first("_first", True).over(by_block.rowsBetween(1, Window.unboundedFollowing)).alias("_out"),
    )
    local = Window.partitionBy(*keys, "_block").orderBy(index)
    return (
        blocks.withColumn("_l", F.last("_mark", True).over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_r", F.first("_mark", True).over(local.rowsBetween(0, Window.unboundedFollowing)))
        .join(carried, [*keys, "_block"])
        .withColumn("before", F.coalesce("_l", "_in"))
        .withColumn("after", F.coalesce("_r", "_out"))
        .drop("_block", "_mark", "_l", "_r", "_in", "_out")
    )
