"""Stationarity and trend statistics per series, from partial sums."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.functions.numeric import lookup_interpolate, normal_cdf
from metricwatch.operators.correlation import centred, lag_products
from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import BLOCK_ROWS, rolling, row_index, running_sum

# Asymptotic distribution of the ADF statistic with constant (tau, p).
ADF_TABLE = (
    (-6.0, 0.00001), (-5.0, 0.0001), (-4.5, 0.0005), (-4.0, 0.002), (-3.5, 0.007), (-3.43, 0.01),
    (-3.2, 0.02), (-3.0, 0.031), (-2.86, 0.05), (-2.57, 0.1), (-2.3, 0.175), (-2.0, 0.27),
    (-1.7, 0.375), (-1.4, 0.485), (-1.1, 0.595), (-0.8, 0.7), (-0.5, 0.79), (0.0, 0.9),
    (0.5, 0.96), (1.0, 0.985), (2.0, 0.999),
)
# KPSS level statistic (eta, p).
KPSS_TABLE = (
    (0.05, 0.99), (0.1, 0.9), (0.2, 0.7), (0.3, 0.2), (0.347, 0.1), (0.4, 0.07), (0.463, 0.05),
    (0.574, 0.025), (0.739, 0.01), (1.0, 0.003), (1.5, 0.0005), (2.0, 0.0001),
)
DIGIT_BITS, DIGITS = 8, 256  # digits in which ranks are compared
KPSS_LAGS = 1_024  # the bandwidth rule reaches this at 6e12 rows


def adf(indexed: DataFrame, lags: int = 1, value: str = "value") -> DataFrame:
    """Dickey-Fuller t statistic of x[t-1] in Δx[t] ~ 1 + x[t-1] (+ Δx[t-1]), and its p-value."""
    wide = rolling(indexed, {
        "_x": lambda w: F.lag(value).over(w),
        "_x2": lambda w: F.lag(value, 2).over(w),
    }, back=2).withColumn("_y", F.col(value) - F.col("_x")).withColumn("_z", F.col("_x") - F.col("_x2"))
    rows = wide.where(F.col("_z" if lags else "_x").isNotNull())
    pairs = {"yy": ("_y", "_y"), "xx": ("_x", "_x"), "xy": ("_x", "_y"), "zz": ("_z", "_z"), "xz": ("_x", "_z"), "zy": ("_z", "_y")}
    s = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("m"), *[F.covar_pop(a, b).alias(name) for name, (a, b) in pairs.items()]
    )
    c, m = F.col, F.col("m").cast("double")
    if lags:
        det = c("xx") * c("zz") - c("xz") * c("xz")
        beta = (c("zz") * c("xy") - c("xz") * c("zy")) / det
        gamma = (c("xx") * c("zy") - c("xz") * c("xy")) / det
        rss, inverse, free = c("yy") - beta * c("xy") - gamma * c("zy"), c("zz") / det, m - 3
    else:
        det = c("xx")
        beta = c("xy") / c("xx")
        rss, inverse, free = c("yy") - beta * c("xy"), F.lit(1.0) / c("xx"), m - 2
    error = F.sqrt(F.greatest(rss, F.lit(0.0)) / free * inverse)
    stat = F.when((det > 0) & (free > 0) & (error > 0), beta / error)
    out = s.withColumn("adf", stat)
    p = F.when(F.col("adf").isNull(), F.lit(1.0)).otherwise(lookup_interpolate(F.col("adf"), ADF_TABLE))
    return out.select("series_id", F.coalesce("adf", F.lit(0.0)).alias("adf"), p.alias("adf_p"))


def kpss_bandwidth(n: Column) -> Column:
    width = F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0)))
    return F.least(F.greatest(width, F.lit(1)), n - 1).cast("long")


def kpss(indexed: DataFrame) -> DataFrame:
    """Level-stationarity statistic with a Bartlett long-run variance, and its p-value."""
    rows = centred(indexed).withColumn("_top", kpss_bandwidth(F.col("n")))
    partial = running_sum(rows, {"_s": "x"}).groupBy("series_id").agg(
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.first("n").alias("n"), F.first("_top").alias("_top")
    )
    products = lag_products(rows, None, "x", "_top", KPSS_LAGS)
    weight = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(
        F.lit(2.0) * (F.lit(1.0) - F.col("lag") / (F.col("_top") + 1))
    )
    long_run = products.join(partial.select("series_id", "n", "_top"), "series_id").groupBy("series_id").agg(
        F.sum(weight * F.col("product") / F.col("n")).alias("_lrv")
    )
    stat = F.when(F.col("_lrv") > 0, F.col("_ss") / (F.col("n").cast("double") * F.col("n") * F.col("_lrv")))
    out = partial.join(long_run, "series_id").withColumn("kpss", stat)
    p = F.when(F.col("kpss").isNull(), F.lit(1.0)).otherwise(lookup_interpolate(F.col("kpss"), KPSS_TABLE))
    return out.select("series_id", F.coalesce("kpss", F.lit(0.0)).alias("kpss"), p.alias("kpss_p"))


def is_stationary(method: str, significance: float = 0.05) -> Column:
    by_adf, by_kpss = F.col("adf_p") < significance, F.col("kpss_p") > significance
    return {"adf": by_adf, "kpss": by_kpss, "both": by_adf & by_kpss}.get(method, by_adf | by_kpss)


def linear_trend(indexed: DataFrame, value: str = "value") -> DataFrame:
    """Slope over row positions with fit, t statistic, normal p-value, strength and direction."""
    s = indexed.groupBy("series_id").agg(
        F.count(value).alias("n"), F.avg(value).alias("_mean"),
        F.var_pop("rn").alias("_xx"), F.var_pop(value).alias("_yy"), F.covar_pop("rn", value).alias("_xy"),
    )
    n = F.col("n").cast("double")
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(F.lit(0.0))
    r2 = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") * F.col("_xy") / (F.col("_xx") * F.col("_yy"))).otherwise(F.lit(0.0))
    wide = s.withColumn("slope", slope).withColumn("r_squared", r2)
    error = F.sqrt(F.greatest(F.lit(1.0) - F.col("r_squared"), F.lit(0.0)) * F.col("_yy") / (n - 2) / F.col("_xx"))
    t = F.when((n > 2) & (error > 1e-10), F.col("slope") / error).otherwise(F.lit(0.0))
    strength = F.tanh(F.abs("slope") * n / F.greatest(F.abs("_mean"), F.lit(1e-10)))
    direction = F.when(F.col("slope") > 0.01, 1).when(F.col("slope") < -0.01, -1).otherwise(0)
    return (
        wide.withColumn("t_statistic", t)
        .withColumn("p_value", F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs("t_statistic"))))
        .withColumn("strength", strength).withColumn("direction", direction)
        .withColumn("_std", F.sqrt("_yy"))
        .select("series_id", "n", "slope", "r_squared", "t_statistic", "p_value", "strength", "direction", F.col("_std").alias("std"))
    )


def value_ranks(indexed: DataFrame, value: str = "value", cuts: int = 256) -> DataFrame:
    """Add `rank`: dense 0-based rank of the value within its series.

    Distinct values are numbered stretch by stretch between sketched cut values, so no task
    sorts more than a fraction of a series.
    """
    probs = [i / cuts for i in range(1, cuts)]
    sketch = indexed.groupBy("series_id").agg(F.percentile_approx(value, probs, 10 * cuts).alias("_cuts"))
    distinct = indexed.select("series_id", value).distinct()
    placed = attach(distinct, sketch, spread_by=value).withColumn(
        "_chunk", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    )
    ranked = row_index(placed.drop("_cuts"), order=value, chunk=F.col("_chunk"), out="rank")
    return attach(indexed, ranked.select("series_id", value, "rank"), ["series_id", value], "inner", "rn")


def later_signs(group: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per row its weight times the summed weight of earlier rows of its group, smaller ranks minus larger ones.

    Two ranks first differ at one bit; among rows that share the bits above it, running sums of the
    zeros and ones before a row count its pairs at that bit.
    """
    out = np.zeros(len(rank), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        high = rank >> (bit + 1)
        # one key per group and higher bits, kept in the order of arrival
        order = np.lexsort((high, group)) if group.any() else np.argsort(high, kind="stable")
        g, h, w = group[order], high[order], weight[order]
        one = (rank[order] >> bit) & 1
        fresh = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
        ones, zeros = (np.r_[0, np.cumsum(w * x)] for x in (one, 1 - one))
        at = np.arange(len(g))
        out[order] += w * np.where(one == 1, zeros[at] - zeros[first], ones[first] - ones[at])
    return out


def _signs_inside(block: pd.DataFrame) -> pd.DataFrame:
    """The sign sum over the pairs of one block of rows."""
    block = block.sort_values("rn")
    rank = np.unique(block["rank"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    ones = np.ones(len(rank), np.int64)
    s = int(later_signs(np.zeros(len(rank), np.int64), rank, ones).sum())
    return pd.DataFrame({"series_id": [block["series_id"].iloc[0]], "s": [s]})


CELL = ["series_id", "level", "prefix"]


def _signs_across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sign sums over pairs of different blocks, from counts `CELL, block, digit, c` in that order.

    A cell goes on in the next batch with one count per digit; the rows of a block cut by a batch wait for its rest.
    """
    waiting, cell_before, seen = None, None, np.zeros(DIGITS, np.int64)
    for batch in chain(batches, [None]):
        rows = waiting if batch is None else batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        fresh = (rows[[*CELL, "block"]] != rows[[*CELL, "block"]].shift()).any(axis=1).to_numpy()
        if batch is not None:
            cut = int(np.flatnonzero(fresh)[-1])
            waiting, rows, fresh = rows.iloc[cut:], rows.iloc[:cut], fresh[:cut]
        if not len(rows):
            continue
        fresh[0] = True
        cell = np.cumsum((rows[CELL] != rows[CELL].shift()).any(axis=1).to_numpy()) - 1
        digit, c = rows["digit"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
        s = later_signs(cell, digit, c)
        starts = np.flatnonzero(fresh)  # digits rise within a block: its own pairs were all counted as rising
        same = (np.add.reduceat(c, starts) ** 2 - np.add.reduceat(c * c, starts)) // 2
        s[starts] -= same
        name = tuple(rows[CELL].iloc[0])
        if name == cell_before:
            mine = cell == 0
            less = np.r_[0, np.cumsum(seen)]
            s[mine] += c[mine] * (less[digit[mine]] - (less[-1] - less[digit[mine] + 1]))
        last = cell == cell[-1]
        if cell[-1] or name != cell_before:
            seen = np.zeros(DIGITS, np.int64)
        np.add.at(seen, digit[last], c[last])
        cell_before = tuple(rows[CELL].iloc[-1])
        sums = pd.DataFrame({"series_id": rows["series_id"].to_numpy(), "s": s}).groupby("series_id", as_index=False)["s"].sum()
        yield sums


def sign_sums(ranked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`series_id, n, s`: sign sum over all ordered pairs of ranks of each series. Pairs are never formed.

    A series is cut into blocks of `block_rows` rows. Pairs inside a block are counted by the task that
    holds it. For pairs of different blocks the ranks are read as digits to the base 256: two ranks
    first differ at one digit, so rows that share the digits above it form a cell, whose counts per
    block and digit say how many pairs rise or fall there. That is one row per row and digit, at
    most four below 2^32 different values, and only in series of more than one block; they are added
    up before the shuffle, and a cell holds at most 256 counts a block.
    """
    rows = ranked.select("series_id", "rn", "rank", F.floor(F.col("rn") / block_rows).alias("block"))
    inside = rows.groupBy("series_id", "block").applyInPandas(_signs_inside, "series_id string, s long")
    top = rows.groupBy("series_id").agg(F.max("rank").alias("_top"), F.count(F.lit(1)).alias("n"), F.max("block").alias("_last"))
    levels = F.ceil(F.length(F.bin("_top")) / DIGIT_BITS).cast("int")
    many = top.where("_last > 0").select("series_id", levels.alias("_levels"))
    wide = attach(rows, many, how="inner", spread_by="rn").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_levels") - 1)))
    digit = F.expr(f"cast(shiftright(rank, level * {DIGIT_BITS}) & {DIGITS - 1} as int)")
    prefix = F.expr(f"CASE WHEN level + 1 < _levels THEN shiftright(rank, (level + 1) * {DIGIT_BITS}) ELSE 0L END")
    counts = wide.groupBy("series_id", "level", prefix.alias("prefix"), "block", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"))
    across = counts.repartition(*CELL).sortWithinPartitions(*CELL, "block", "digit").mapInPandas(_signs_across, "series_id string, s long")
    signs = inside.unionByName(across).groupBy("series_id").agg(F.sum("s").alias("s"))
    return top.select("series_id", "n").join(signs, "series_id")


def mann_kendall(indexed: DataFrame, value: str = "value", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sign sum over all ordered pairs, its z score, p-value and direction."""
    signs = sign_sums(value_ranks(indexed, value), block_rows)
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n - 1) * (n * 2 + 5) / 18)
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / spread).when(F.col("s") < 0, (F.col("s") + 1) / spread).otherwise(F.lit(0.0))
    return (
        signs.withColumn("z", z)
        .withColumn("p_value", F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs("z"))))
        .select("series_id", "n", "s", "z", "p_value", F.signum("s").cast("int").alias("direction"))
    )
