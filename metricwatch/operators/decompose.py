"""Seasonal-trend decomposition by centred means and phase medians.

The trend is a centred moving mean over one period, the seasonal part the median of each
phase of the detrended values, shifted to mean zero. Periods are taken off shortest first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from metricwatch.operators import correlation
from metricwatch.operators.features import trailing_residual
from metricwatch.operators.joins import attach
from metricwatch.operators.ordered import rolling, running_sum
from metricwatch.operators.quantiles import exact_quantiles
from metricwatch.session import cut_lineage, written

STRENGTH = 0.8  # fixed value: weaker seasons do not count
MAX_ROUNDS = 3
MAX_PERIOD = 168
PEAK_SHARE = 0.8


def usable_periods(periods: Column, n: Column) -> Column:
    """Distinct periods that fit at least twice into `n` rows."""
    return F.filter(F.array_distinct(periods), lambda p: p * 2 <= n)


def centred_mean(rows: DataFrame, value: str, out: str, half: Column | int) -> DataFrame:
    """Mean over positions rn - half .. rn + half within the series, missing values left out.

    A fixed half width is a plain frame. One that differs by series, however wide, is a difference
    of two running sums around the series' mean, each fetched by its position.
    """
    if isinstance(half, int):
        def fixed(w: WindowSpec) -> Column:
            return F.avg(value).over(w.rowsBetween(-half, half))

        return rolling(rows, {out: fixed}, half, half)
    stats = rows.groupBy("series_id").agg(F.avg(value).alias("_mean"), F.max("rn").alias("_last"))
    wide = attach(rows, stats, spread_by="rn").withColumn("_to", F.least(F.col("rn") + half, "_last").cast("long")).withColumn("_from", (F.col("rn") - half - 1).cast("long"))
    known = F.col(value).isNotNull()
    sums = running_sum(
        wide.select("series_id", "rn", value, "_mean"),
        {"_s": F.when(known, F.col(value) - F.col("_mean")).otherwise(0.0), "_c": known.cast("long")},
    )
    at = lambda name: sums.select("series_id", F.col("rn").alias(f"_{name}"), F.col("_s").alias(f"_s_{name}"), F.col("_c").alias(f"_c_{name}"))
    wide = wide.join(at("to"), ["series_id", "_to"], "left").join(at("from"), ["series_id", "_from"], "left")
    part = lambda name: F.coalesce(f"_{name}_to", F.lit(0)) - F.coalesce(f"_{name}_from", F.lit(0))
    mean = F.when(part("c") > 0, F.col("_mean") + part("s") / part("c"))
    return wide.withColumn(out, mean).select(*rows.columns, out)


def remove_season(rows: DataFrame, value: str, period: Column | int, season: str) -> DataFrame:
    """Add the seasonal part of `value`: for one period, or one per series (0 where that is NULL)."""
    fixed = isinstance(period, int)
    length = F.lit(period) if fixed else F.coalesce(period, F.lit(1))
    wide = centred_mean(rows, value, "_trend", period // 2 if fixed else F.floor(length / 2))
    phased = wide.withColumn("_phase", F.pmod("rn", length)).withColumn("_away", F.col(value) - F.col("_trend"))
    median = exact_quantiles(phased, ["series_id", "_phase"], "_away", {"_median": 0.5}).drop("n")
    level = median.groupBy("series_id").agg(F.avg("_median").alias("_level"))
    shape = median.join(level, "series_id").select("series_id", "_phase", (F.col("_median") - F.col("_level")).alias("_shape"))
    part = F.coalesce("_shape", F.lit(0.0))
    if not fixed:
        part = F.when(period.isNotNull(), part).otherwise(F.lit(0.0))
    return (
        attach(phased, shape, ["series_id", "_phase"], spread_by="rn").withColumn(season, part)
        .drop("_phase", "_away", "_trend", "_shape")
    )


def decompose(indexed: DataFrame, periods: Sequence[int], value: str = "value") -> DataFrame:
    """Add `trend`, `season_<p>` for each period and `residual`; `indexed` carries `rn` and `n`.

    A period that does not fit twice into a series has a zero season there. The result also
    carries `usable`, the periods that fit.
    """
    wanted = sorted(set(periods))
    fits = usable_periods(F.array(*[F.lit(p) for p in wanted]), F.col("n"))
    rows = indexed.withColumn("_left", F.col(value)).withColumn("usable", fits)
    for p in wanted:
        # Every step reads its input several times; writing it down keeps that from multiplying.
        rows = cut_lineage(remove_season(rows, "_left", p, f"season_{p}"))
        season = F.when(F.array_contains("usable", F.lit(p)), F.col(f"season_{p}")).otherwise(F.lit(0.0))
        rows = rows.withColumn(f"season_{p}", season).withColumn("_left", F.col("_left") - F.col(f"season_{p}"))
    rows = centred_mean(rows, "_left", "trend", max(wanted) // 2)
    return rows.withColumn("residual", F.col("_left") - F.col("trend")).drop("_left")


def seasonal_strength(season: Column, residual: Column) -> Column:
    """1 - Var(residual) / Var(season + residual); 0 without variance."""
    both = F.var_pop(season + residual)
    return F.when(F.abs(both) < 1e-8, F.lit(0.0)).otherwise(F.lit(1.0) - F.var_pop(residual) / both)


def strengths(parts: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Strength of each period per series, and the periods strong enough to keep."""
    wanted = sorted(set(periods))
    stats = parts.groupBy("series_id").agg(
        F.first("usable").alias("usable"),
        *[seasonal_strength(F.col(f"season_{p}"), F.col("residual")).alias(f"strength_{p}") for p in wanted],
    )
    kept = F.array_compact(F.array(*[
        F.when((F.col(f"strength_{p}") >= STRENGTH) & F.array_contains("usable", F.lit(p)), F.lit(p)) for p in wanted
    ]))
    return stats.withColumn("periods", kept).drop("usable")


def season_residuals(indexed: DataFrame, periods: Sequence[int], value: str = "value") -> DataFrame:
    """Add `y`: the residual where a strong season was found, else the value itself."""
    parts = cut_lineage(decompose(indexed, periods, value))
    strong = strengths(parts, periods).select("series_id", "periods")
    wide = attach(parts.select(*indexed.columns, "residual"), strong)
    return wide.withColumn("y", F.when(F.size("periods") > 0, F.col("residual")).otherwise(F.col(value))).drop("residual")


def dominant_period(indexed: DataFrame, value: str, max_period: int = MAX_PERIOD) -> DataFrame:
    """The most frequent distance, up to `max_period`, between significant autocorrelation peaks per series; all lags count."""
    residual = written(trailing_residual(indexed, 2, value).select("series_id", "rn", "residual"))
    ac = written(correlation.circular_autocorrelation(residual, "residual"))  # read for its largest value and for the peaks
    found = correlation.peaks(ac, "ac", F.col("top") * PEAK_SHARE)
    return correlation.top_periods(correlation.peak_intervals(found), 1, 1, max_period).select("series_id", "period")


def auto_decompose(indexed: DataFrame, value: str = "value", rounds: int = MAX_ROUNDS, max_period: int = MAX_PERIOD) -> DataFrame:
    """Up to three rounds of finding one period per series and taking its season and trend off.

    Returns the rows with `y` (what is left) and `periods` found. All series go through a
    round together; each round's result is written to the checkpoint folder.
    """
    rows = indexed.withColumn("y", F.col(value)).withColumn("periods", F.array().cast("array<bigint>")).withColumn("_open", F.lit(True))
    for _ in range(rounds):
        found = dominant_period(rows.where("_open"), "y", max_period)
        fits = F.when(F.col("_open") & (F.col("period") * 2 <= F.col("n")), F.col("period"))
        wide = attach(rows, cut_lineage(found)).withColumn("_p", fits).drop("period")
        wide = written(remove_season(wide, "y", F.col("_p"), "_season"))
        wide = wide.withColumn("_flat", F.col("y") - F.col("_season"))
        wide = written(centred_mean(wide, "_flat", "_trend", F.floor(F.coalesce("_p", F.lit(1)) / 2)))
        wide = wide.withColumn("_res", F.col("_flat") - F.col("_trend"))
        strong = wide.where(F.col("_p").isNotNull()).groupBy("series_id").agg(
            seasonal_strength(F.col("_season"), F.col("_res")).alias("_strength")
        )
        good = F.coalesce(F.col("_strength") >= STRENGTH, F.lit(False))
        rows = written(
            attach(wide, strong)
            .withColumn("y", F.when(good, F.col("_res")).otherwise(F.col("y")))
            .withColumn("periods", F.when(good, F.array_union("periods", F.array("_p"))).otherwise(F.col("periods")))
            .withColumn("_open", good)
            .select(*indexed.columns, "y", "periods", "_open")
        )
        if rows.where("_open").isEmpty():
            break
    return rows.drop("_open")
