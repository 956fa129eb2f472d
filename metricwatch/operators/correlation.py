"""Lagged products of series: autocorrelation, peaks and periods.

For a few lags, a block of consecutive rows with a halo gives its share of every lagged sum; the
shares add up. Blocks have equal size, so a long series is spread over many tasks.

For all lags, every block is transformed (FFT) and cut into stretches of frequencies. A task holds
one stretch of all blocks and adds up the products of block pairs at equal distance, by a second
transform across the blocks; one inverse transform for each distance gives the sums. Rows move
three times, whatever the number of lags, and no task holds more than CELLS values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import BLOCK_ROWS, rolling, with_halo

HALO = 4_096  # lags up to which blocks with a halo are used where the bound is known
CELLS = 1 << 20  # spectrum values of a series in one task


def lag_products(
    indexed: DataFrame,
    lags: Sequence[int] | None,
    value: str = "value",
    max_lag: str | None = None,
    limit: int | None = None,
    index: str = "rn",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`series_id, lag, product, pairs`: Σ x[i]·x[i-lag] over each series.

    `lags` lists the lags wanted; without it all lags from 0 to the row's `max_lag` column. A
    `limit` that no row's `max_lag` exceeds (a larger one is an error) keeps to blocks with a halo
    of that width; without a limit all lags are computed at once, see `all_lag_products`.
    """
    if lags is None and limit is None:
        every = all_lag_products(indexed, value, index, block_rows)
        tops = indexed.groupBy("series_id").agg(F.max(max_lag).alias("_most"))
        return attach(every, tops, spread_by="lag").where(F.col("lag") <= F.col("_most")).select("series_id", "lag", "product", (F.col("n") - F.col("lag")).alias("pairs"))
    if lags is None:
        fits = F.when(F.col(max_lag) > limit, F.raise_error(F.lit(f"a series asks for lags beyond {limit}"))).otherwise(F.col(max_lag))
        indexed = indexed.withColumn(max_lag, fits)
    wanted = None if lags is None else np.asarray(sorted(set(lags)), dtype=np.int64)
    back = limit if wanted is None else int(wanted.max())
    columns = ["series_id", index, value] + ([max_lag] if max_lag else [])
    blocks = with_halo(indexed.select(*columns), back, index=index, block_rows=block_rows)
    own = F.col("_block") == F.col("_home")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(index)
        at, x, mine = (group[c].to_numpy() for c in (index, value, "_own"))
        steps = wanted if wanted is not None else np.arange(int(group[max_lag].max()) + 1)
        dense = np.zeros(int(at[-1] - at[0]) + 1)
        dense[at - at[0]] = x
        first = int(at[mine][0] - at[0]) if mine.any() else len(dense)
        total, pairs = np.zeros(len(steps)), np.zeros(len(steps), dtype=np.int64)
        for i, lag in enumerate(steps):
            start = max(first, int(lag))
            if start < len(dense):
                total[i] = dense[start:] @ dense[start - lag: len(dense) - lag]
                pairs[i] = len(dense) - start
        return pd.DataFrame({"series_id": group["series_id"].iloc[0], "lag": steps, "product": total, "pairs": pairs})

    shares = blocks.withColumn("_own", own).drop("_home").groupBy("series_id", "_block").applyInPandas(
        one, "series_id string, lag long, product double, pairs long"
    )
    return shares.groupBy("series_id", "lag").agg(F.sum("product").alias("product"), F.sum("pairs").alias("pairs"))


def all_lag_products(
    indexed: DataFrame, value: str = "value", index: str = "rn", block_rows: int = BLOCK_ROWS, max_lag: int | None = None,
) -> DataFrame:
    """`series_id, n, lag, product`: Σ x[i]·x[i-lag] for every lag below the series' length n, or up to `max_lag`.

    Positions of a series are consecutive. A missing value counts as 0.
    """
    sizes = indexed.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("_start"))
    # a short series is one block, no longer than it has to be
    size = F.least(F.lit(block_rows), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("int")))
    sizes = sizes.withColumn("_size", size)
    rows = attach(indexed.select("series_id", index, value), sizes, how="inner", spread_by=index).withColumn("_pos", F.col(index) - F.col("_start"))
    rows = rows.select("series_id", "n", "_size", F.expr("_pos div _size").alias("_block"), F.expr("_pos % _size").alias("_at"), F.coalesce(value, F.lit(0.0)).cast("double").alias("_x"))
    keys = "series_id string, n long, _size int"

    def parts(n: int, size: int) -> list[tuple[int, int]]:
        """The stretches of frequencies of a series; one stretch of all blocks has at most CELLS values."""
        width = max(1, CELLS // -(-n // size))
        return [(i, min(i + width, size + 1)) for i in range(0, size + 1, width)]

    def table(key: tuple, spectra: list[tuple[dict, np.ndarray]]) -> pa.Table:
        series, n, size = key
        body = {"series_id": pa.array([series] * len(spectra), pa.string()), "n": pa.array([n] * len(spectra), pa.int64()), "_size": pa.array([size] * len(spectra), pa.int32())}
        for name in ("_line", "_part"):
            body[name] = pa.array([s[0][name] for s in spectra], pa.int64())
        for name, take in (("re", np.real), ("im", np.imag)):
            body[name] = pa.array([take(s[1]).astype(np.float64) for s in spectra], pa.list_(pa.float64()))
        return pa.table(body)

    def forward(group: pa.Table) -> pa.Table:
        key = tuple(group[c][0].as_py() for c in ("series_id", "n", "_size"))
        x = np.zeros(2 * key[2])
        x[group["_at"].to_numpy()] = group["_x"].to_numpy()
        spectrum, block = np.fft.rfft(x), group["_block"][0].as_py()
        return table(key, [({"_line": block, "_part": i}, spectrum[a:b]) for i, (a, b) in enumerate(parts(*key[1:]))])

    def across(group: pa.Table) -> pa.Table:
        key = tuple(group[c][0].as_py() for c in ("series_id", "n", "_size"))
        blocks, part = -(-key[1] // key[2]), group["_part"][0].as_py()
        rows = np.zeros((2 * blocks, len(group["re"][0])), np.complex128)
        for at, re, im in zip(group["_line"].to_pylist(), group["re"], group["im"]):
            rows[at] = re.values.to_numpy() + 1j * im.values.to_numpy()
        # along the blocks this is an autocorrelation again
        sums = np.fft.ifft(np.abs(np.fft.fft(rows, axis=0)) ** 2, axis=0)[:blocks]
        last = blocks if max_lag is None else min(blocks, max_lag // key[2] + 2)
        return table(key, [({"_line": d, "_part": part}, sums[d]) for d in range(last)])

    def back(group: pa.Table) -> pa.Table:
        key = tuple(group[c][0].as_py() for c in ("series_id", "n", "_size"))
        series, n, size = key
        far, group = group["_line"][0].as_py(), group.sort_by("_part")
        spectrum = group["re"].combine_chunks().flatten().to_numpy() + 1j * group["im"].combine_chunks().flatten().to_numpy()
        sums = np.fft.irfft(spectrum, 2 * size)
        lags = far * size + np.r_[np.arange(size), np.arange(-size, 0)]
        keep = (lags >= 0 if far else np.arange(2 * size) < size) & (lags < n) & (lags <= (n if max_lag is None else max_lag))
        count = int(keep.sum())
        return pa.table({"series_id": pa.array([series] * count, pa.string()), "n": pa.array(np.full(count, n)), "lag": pa.array(lags[keep]), "product": pa.array(sums[keep])})

    lines = f"{keys}, _line long, _part long, re array<double>, im array<double>"
    spectra = rows.groupBy("series_id", "n", "_size", "_block").applyInArrow(forward, lines)
    sums = spectra.groupBy("series_id", "n", "_size", "_part").applyInArrow(across, lines)
    shares = sums.groupBy("series_id", "n", "_size", "_line").applyInArrow(back, "series_id string, n long, lag long, product double")
    return shares.groupBy("series_id", "n", "lag").agg(F.sum("product").alias("product"))


def centred(indexed: DataFrame, value: str = "value") -> DataFrame:
    """Add `x` (value minus the series' mean, 0 for a missing one) and `n`, the number of values.

    A missing value counts as the mean, so it adds nothing to any lagged sum.
    """
    stats = indexed.groupBy("series_id").agg(F.avg(value).alias("_mean"), F.count(value).alias("n"))
    return attach(indexed.drop("n"), stats).withColumn("x", F.coalesce(F.col(value) - F.col("_mean"), F.lit(0.0))).drop("_mean")


def autocorrelation(
    indexed: DataFrame, lags: Sequence[int] | None = None, max_lag: Column | int | None = None, limit: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`series_id, lag, acf, n`: Σ(x[i]-m)(x[i-lag]-m) / Σ(x[i]-m)², NULL without spread.

    Without `lags` all lags up to `max_lag`; a bound that is known for all series (a number, or
    `limit`) and short for a block keeps to blocks with a halo.
    """
    rows = centred(indexed)
    if lags is None:
        top = F.lit(max_lag) if isinstance(max_lag, int) else max_lag
        rows = rows.withColumn("_top", F.least(top, F.col("n") - 1))
        bound = max_lag if isinstance(max_lag, int) else limit
        sums = lag_products(rows, None, "x", "_top", bound if bound is not None and bound <= HALO else None, block_rows=block_rows)
    else:
        sums = lag_products(rows, [0, *lags], "x", block_rows=block_rows)
    zero = sums.where(F.col("lag") == 0).select("series_id", F.col("product").alias("_c0"), F.col("pairs").alias("n"))
    acf = F.when(F.col("_c0") > 0, F.col("product") / F.col("_c0"))
    return sums.join(zero, "series_id").where(F.col("lag") < F.col("n")).select("series_id", "lag", acf.alias("acf"), "n")


def acf_vector(indexed: DataFrame, max_lag: int) -> DataFrame:
    """Autocorrelations of lags 0..max_lag as one array per series, clamped to [-1, 1]."""
    acf = autocorrelation(indexed, max_lag=max_lag)
    value = F.greatest(F.least(F.coalesce("acf", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    pair = F.sort_array(F.collect_list(F.struct("lag", value.alias("v"))))
    return acf.groupBy("series_id").agg(F.transform(pair, lambda p: p["v"]).alias("acf"))


def peaks(sequence: DataFrame, value: str, floor: Column, order: str = "lag") -> DataFrame:
    """Rows above both neighbours and at least `floor` (may use `top`, the largest value after lag 0)."""
    tops = sequence.where(F.col(order) > 0).groupBy("series_id").agg(F.max(value).alias("top"))
    wide = rolling(sequence, {"_l": lambda w: F.lag(value).over(w), "_r": lambda w: F.lead(value).over(w)}, 1, 1, index=order)
    wide = attach(wide, tops, how="inner", spread_by=order)
    high = (F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r")) & (F.col(value) >= floor)
    return wide.where(high).drop("_l", "_r", "top")


def circular_autocorrelation(indexed: DataFrame, value: str, max_lag: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`series_id, lag, ac, n`: mean of x[i]·x[(i+lag) mod n] for every lag below n, or up to `max_lag`.

    The wrapped pairs of a lag are the plain pairs of n - lag. A missing value counts as 0.
    """
    plain = all_lag_products(indexed, value, block_rows=block_rows)
    mirrored = F.when(F.col("lag") > 0, F.col("n") - F.col("lag"))
    both = plain.withColumn("lag", F.explode(F.array_compact(F.array("lag", mirrored))))
    if max_lag is not None:
        both = both.where(F.col("lag") <= max_lag)
    sums = both.groupBy("series_id", "n", "lag").agg(F.sum("product").alias("_sum"))
    return sums.select("series_id", "lag", (F.col("_sum") / F.col("n")).alias("ac"), "n")


def peak_intervals(found: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Distances between peaks with their frequency: of neighbours, or of any two peaks.

    Any two: a distance occurs as often as the peaks and the peaks moved by it have lags in
    common, so no pairs are formed. Peaks of a series are at most half its lag limit.
    """
    if all_pairs:
        sets = found.groupBy("series_id").agg(F.collect_set("lag").alias("_p"), (F.max("lag") - F.min("lag")).alias("_w"))
        steps = sets.where(F.col("_w") > 0).withColumn("interval", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_w"))))
        moved = F.transform("_p", lambda lag: lag + F.col("interval"))
        both = F.size(F.array_intersect("_p", moved)).cast("long")
        return steps.select("series_id", "interval", both.alias("frequency")).where(F.col("frequency") > 0)
    w = Window.partitionBy("series_id").orderBy("lag")
    gaps = found.select("series_id", (F.col("lag") - F.lag("lag").over(w)).alias("interval"))
    return gaps.where(F.col("interval").isNotNull()).groupBy("series_id", "interval").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def top_periods(intervals: DataFrame, top: int, low: int, high: int) -> DataFrame:
    """The `top` most frequent intervals within [low, high]; ties go to the shorter."""
    w = Window.partitionBy("series_id").orderBy(F.desc("frequency"), "interval")
    kept = intervals.where(F.col("interval").between(low, high)).withColumn("rank", F.row_number().over(w))
    return kept.where(F.col("rank") <= top).select("series_id", F.col("interval").alias("period"), "frequency", "rank")
