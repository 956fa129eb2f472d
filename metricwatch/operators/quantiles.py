"""Exact order statistics per group, without gathering a group in one task.

A sketch proposes cut values close around each wanted rank; counting the rows between cuts
tells exactly which stretch holds the rank; only that stretch is sorted. A stretch of more rows
than a task should sort is cut again, and again, until it is short enough. The sketch decides
how little is sorted, never what comes out. With few enough keys the rows are only scanned:
cuts and ranks are broadcast to them, and nothing but the stretch is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.operators.joins import SALT, attach, attach_checked, attach_known, salt
from metricwatch.session import cut_lineage

ACCURACY = 10_000
MARGIN = 0.002
SORTED = 65_536  # different values of one stretch that a task sorts
GRID = 64  # parts that a longer stretch is cut into in each round
MAD_SIGMA = 1.4826  # fixed value: MAD to standard deviation under normality


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    kind: str = "linear",
    most: int = SORTED,
) -> DataFrame:
    """One row per key: `n` and each named quantile. `kind` as in numpy's older interpolation names.

    No task sorts more than `most` different values of a key and stretch. Missing values do not count.
    """
    keys = list(keys)
    cuts = sorted({min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-MARGIN, MARGIN)})
    stretches = range(len(cuts) + 1)
    rows = salt(df.where(F.col(value).isNotNull()), value).select(*keys, SALT, F.col(value).alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", cuts, ACCURACY).alias("_cuts"), F.count(F.lit(1)).alias("n")
    )
    stretch = sum(((F.col("_v") > F.col("_cuts")[i]).cast("int") for i in range(len(cuts))), F.lit(0))
    placed = attach_checked(rows, sketch, keys, "inner").withColumn("_stretch", stretch)
    sizes = placed.groupBy(*keys).agg(
        F.first("n").alias("_n"),
        *[F.count_if(F.col("_stretch") == i).alias(f"_size{i}") for i in stretches],
    )
    wanted = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        wanted.append((name, h, F.floor(h), F.least(F.floor(h) + 1, F.col("n") - 1)))
    # Rank at which each stretch starts, NULL where no wanted rank lies in it.
    ranks = [rank for _, _, lo, hi in wanted for rank in (lo, hi)]
    ends = [sum((F.col(f"_size{j}") for j in range(i)), F.lit(0).cast("long")) for i in range(len(cuts) + 2)]
    marks = sizes.withColumnRenamed("_n", "n").select(
        *keys, *[end.alias(f"_end{i}") for i, end in enumerate(ends)], *[r.alias(f"_rank{j}") for j, r in enumerate(ranks)]
    )

    def start(i: int) -> Column:
        inside = F.lit(False)
        for j in range(len(ranks)):
            inside = inside | ((F.col(f"_rank{j}") >= F.col(f"_end{i}")) & (F.col(f"_rank{j}") < F.col(f"_end{i + 1}")))
        return F.when(inside, F.col(f"_end{i}"))

    starts = [start(i) for i in stretches]
    size = [F.when(s.isNotNull(), F.col(f"_end{i + 1}") - F.col(f"_end{i}")) for i, s in enumerate(starts)]
    hit = cut_lineage(marks.select(*keys, F.array(*starts).alias("_starts"), F.array_max(F.array(*size)).alias("_long")))
    longest = hit.agg(F.max("_long")).first()[0] or 0
    tight = (
        attach_known(placed.drop("_cuts"), hit.drop("_long"), keys, "inner")
        .withColumn("_base", F.get("_starts", F.col("_stretch")))
        .where(F.col("_base").isNotNull())
        .groupBy(*keys, "_base", "n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    if longest > most:
        inside = lambda a, b: reduce(or_, ((r >= a) & (r < b) for r in ranks))
        tight = _narrowed(tight, keys, inside, most)
    run = Window.partitionBy(*keys, "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tight.withColumn("_end", F.col("_base") + F.sum("_c").over(run)).withColumn(
        "_start", F.col("_end") - F.col("_c")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[at(lo).alias(f"_lo_{name}") for name, _, lo, _ in wanted],
        *[at(hi).alias(f"_hi_{name}") for name, _, _, hi in wanted],
    )
    out = []
    for name, h, _, _ in wanted:
        out.append(interpolate(F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), h - F.floor(h), kind).alias(name))
    return picked.select(*keys, "n", *out)


def _narrowed(counts: DataFrame, keys: Sequence[str], inside: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """Counts of values `(keys, _base, n, _v, _c)` in which no stretch has more than `most` different values.

    A stretch is known by the rank `_base` of its first row. In each round a sketch of its different
    values gives GRID cuts; the parts between them that hold a wanted rank stay, each as a stretch of
    its own. A part has about a GRID-th of the values, so three rounds take a stretch of 10^10 values
    to below 65,536.
    """
    group = [*keys, "_base"]
    grid = [i / GRID for i in range(1, GRID)]
    done = []
    while True:
        counts = cut_lineage(counts)
        sizes = cut_lineage(counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")))
        if (sizes.agg(F.max("_size")).first()[0] or 0) <= most:
            return reduce(DataFrame.unionByName, done, counts)
        split = attach_known(salt(counts, "_v"), sizes, group, "inner")
        done.append(split.where(F.col("_size") <= most).drop("_size", SALT))
        large = split.where(F.col("_size") > most).drop("_size")
        cuts = large.groupBy(*group).agg(F.percentile_approx("_v", grid, ACCURACY).alias("_cuts"))
        part = F.size(F.filter("_cuts", lambda cut: cut < F.col("_v")))
        parted = attach_checked(large, cuts, group, "inner").withColumn("_part", part).drop("_cuts")
        held = parted.groupBy(*group, "_part").agg(F.first("n").alias("n"), F.sum("_c").alias("_rows"))
        before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # GRID rows
        held = held.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        held = held.where(inside(F.col("_from"), F.col("_from") + F.col("_rows"))).select(*group, "_part", "_from")
        kept = attach_checked(parted, held, [*group, "_part"], "inner")
        counts = kept.select(*keys, F.col("_from").alias("_base"), "n", "_v", "_c")


def interpolate(lo: Column, hi: Column, fraction: Column, kind: str) -> Column:
    """Value between two neighbouring order statistics."""
    if kind == "linear":
        return lo + fraction * (hi - lo)
    if kind == "lower":
        return lo
    if kind == "higher":
        return hi
    if kind == "nearest":
        return F.when(fraction < 0.5, lo).otherwise(hi)
    if kind == "midpoint":
        return (lo + hi) / 2
    raise ValueError(f"unknown interpolation {kind!r}")


def floored_scale(mad: Column, median: Column) -> Column:
    """MAD as a standard deviation, with a floor relative to the median and an absolute one."""
    return F.greatest(mad * MAD_SIGMA, F.abs(median) * 0.005, F.lit(1e-9))


def median_mad(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Exact `n`, `median` and floored `scale` per key, for groups of any size."""
    rows = salt(df.where(F.col(value).isNotNull()), value)
    med = exact_quantiles(rows, keys, value, {"median": 0.5})
    dev = attach_checked(rows, med, keys, "inner").withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(dev, keys, "_dev", {"_mad": 0.5}).drop("n")
    return med.join(mad, list(keys)).select(
        *keys, "n", "median", floored_scale(F.col("_mad"), F.col("median")).alias("scale")
    )


def iqr(df: DataFrame, keys: Sequence[str], value: str = "value", lower: float = 0.25,
        upper: float = 0.75, scale: float = 1.0, kind: str = "linear") -> DataFrame:
    """Quartile-like pair and their scaled distance per key."""
    pair = exact_quantiles(df, keys, value, {"q_lower": lower, "q_upper": upper}, kind)
    return pair.withColumn("iqr", (F.col("q_upper") - F.col("q_lower")) / F.lit(scale))


def bucket_median_mad(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """`median_mad` for seasonal buckets, which lookback and slot width bound.

    A bucket holds one sample per second at most: 90 days of hour slots are 324,000 values,
    so the built-in aggregate's value map stays small.
    """
    med = df.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"))
    dev = attach(df, med, keys, "inner")
    mad = dev.groupBy(*keys, "n", "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("_mad"))
    return mad.select(*keys, "n", "median", floored_scale(F.col("_mad"), F.col("median")).alias("scale"))


def bucket_hampel(df: DataFrame, keys: Sequence[str], k: float, value: str = "value") -> DataFrame:
    """Median and scale over the bucket's inliers; over all samples when fewer than three remain."""
    keys = list(keys)
    whole = bucket_median_mad(df, keys, value)
    inliers = attach(df, whole, keys, "inner").where(
        F.abs(F.col(value) - F.col("median")) <= F.lit(k) * F.col("scale")
    ).select(*df.columns)
    clean = bucket_median_mad(inliers, keys, value).select(
        *keys, F.col("n").alias("_n"), F.col("median").alias("_m"), F.col("scale").alias("_s")
    )
    keep = F.coalesce(F.col("_n") >= 3, F.lit(False))
    return whole.join(clean, keys, "left").select(
        *keys,
        "n",
        F.when(keep, F.col("_m")).otherwise(F.col("median")).alias("median"),
        F.when(keep, F.col("_s")).otherwise(F.col("scale")).alias("scale"),
    )
