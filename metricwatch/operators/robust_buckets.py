"""Robust statistics of seasonal buckets from their value counts.

Spark reduces each bucket to its distinct values with counts before the shuffle; a task then
sees one bucket's counts as arrays. One sample per second, the slot width and the lookback
bound a seasonal bucket (90 days of hour slots: 324,000 samples, 5 MB). A bucket with more than
LARGE different values (a series without a season has a single one) is never gathered: all large
buckets go through rounds of exact quantiles together, and leave when they are settled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.operators.joins import attach
from metricwatch.operators.quantiles import MAD_SIGMA, median_mad
from metricwatch.session import cut_lineage

LARGE = 400_000  # different values of a bucket up to which it is handled in one task


def value_counts(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return (
        samples.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    )


def middle(v: np.ndarray, c: np.ndarray) -> float:
    """Median of sorted values `v` repeated `c` times."""
    ends = np.cumsum(c)
    n = ends[-1]
    lo, hi = np.searchsorted(ends, [(n - 1) // 2, n // 2], side="right")
    return float((v[lo] + v[hi]) / 2.0)


def center_scale(v: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Median and floored MAD scale of sorted value counts."""
    med = middle(v, c)
    dev = np.abs(v - med)
    order = np.argsort(dev, kind="stable")
    mad = middle(dev[order], c[order])
    return med, max(mad * MAD_SIGMA, abs(med) * 0.005, 1e-9)


def scrub(v: np.ndarray, c: np.ndarray, k: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Drop values beyond k scales of the median until nothing changes; never below `min_samples`."""
    while c.sum() > min_samples:
        med, scale = center_scale(v, c)
        keep = np.abs(v - med) <= k * scale
        if keep.all() or c[keep].sum() < min_samples:
            break
        v, c = v[keep], c[keep]
    return v, c


def _sorted(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    v, c = group["v"].to_numpy(float), group["c"].to_numpy(np.int64)
    order = np.argsort(v, kind="stable")
    return v[order], c[order]


def _split(samples: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Value counts of the buckets that fit a task, and the samples of the others, if there are any."""
    counts = cut_lineage(value_counts(samples, keys))
    large = cut_lineage(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_kinds")).where(F.col("_kinds") > LARGE).select(*keys))
    if large.isEmpty():
        return counts, None
    known = samples.where(F.col("value").isNotNull()).select(*keys, "value")
    return counts.join(large, keys, "left_anti"), cut_lineage(attach(known, large, keys, "inner", "value"))


def _settled_ranges(samples: DataFrame, k: float, min_samples: int, keys: list[str]) -> DataFrame:
    """`keep_ranges` of buckets of any size: each round narrows all open ones; what a round keeps is an interval."""
    state = cut_lineage(samples.groupBy(*keys).agg(F.min("value").alias("keep_from"), F.max("value").alias("keep_to")))
    done = None
    while True:
        inside = F.col("value").between(F.col("keep_from"), F.col("keep_to"))
        rows = cut_lineage(attach(samples, state, keys, "inner", "value").where(inside))
        stats = median_mad(rows, keys)
        near = F.abs(F.col("value") - F.col("median")) <= F.lit(float(k)) * F.col("scale")
        kept = F.when(near, F.col("value"))
        judged = attach(rows, stats, keys, "inner", "value").groupBy(*keys, "n", "keep_from", "keep_to").agg(
            F.count(kept).alias("_kept"), F.min(kept).alias("_from"), F.max(kept).alias("_to"))
        settled = (F.col("n") <= min_samples) | (F.col("_kept") == F.col("n")) | (F.col("_kept") < min_samples)
        judged = cut_lineage(judged.withColumn("_settled", settled))
        closed = judged.where("_settled").select(*keys, "keep_from", "keep_to")
        done = closed if done is None else done.unionByName(closed)
        state = judged.where("NOT _settled").select(*keys, F.col("_from").alias("keep_from"), F.col("_to").alias("keep_to"))
        if state.isEmpty():
            return done


def keep_ranges(samples: DataFrame, k: float, min_samples: int, keys: Sequence[str] = ("series_id", "bucket")) -> DataFrame:
    """The value range of each bucket that survives scrubbing."""
    keys = list(keys)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        v, _ = scrub(*_sorted(group), k, min_samples)
        out = group[keys].iloc[:1].copy()
        out["keep_from"], out["keep_to"] = v[0], v[-1]
        return out

    counts, large = _split(samples, keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema.fields)
    ranges = counts.groupBy(*keys).applyInPandas(one, f"{kinds}, keep_from double, keep_to double")
    return ranges if large is None else ranges.unionByName(_settled_ranges(large, k, min_samples, keys))


def bucket_stats(samples: DataFrame, k: float, min_samples: int, keys: Sequence[str] = ("series_id", "bucket")) -> DataFrame:
    """Count, Hampel median and scale, mean and population std per bucket.

    Statistics of buckets with fewer than `min_samples` samples are NULL.
    """
    keys = list(keys)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        v, c = _sorted(group)
        n = int(c.sum())
        out = group[keys].iloc[:1].copy()
        out["count"] = n
        if n < min_samples:
            out["median"] = out["scale"] = out["mean"] = out["std"] = np.nan
            return out
        med, scale = center_scale(v, c)
        keep = np.abs(v - med) <= k * scale
        if c[keep].sum() >= 3:
            med, scale = center_scale(v[keep], c[keep])
        mean = float((v * c).sum() / n)
        var = float(((v - mean) ** 2 * c).sum() / n)
        out["median"], out["scale"], out["mean"], out["std"] = med, scale, mean, var ** 0.5
        return out

    counts, large = _split(samples, keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema.fields)
    stats = counts.groupBy(*keys).applyInPandas(
        one, f"{kinds}, count long, median double, scale double, mean double, std double"
    )
    stats = stats.select(*keys, "count", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("median", "scale", "mean", "std")])
    return stats if large is None else stats.unionByName(_stats_of_large(large, k, min_samples, keys))


def _stats_of_large(samples: DataFrame, k: float, min_samples: int, keys: list[str]) -> DataFrame:
    """`bucket_stats` of buckets of any size."""
    whole = median_mad(samples, keys)
    near = F.abs(F.col("value") - F.col("median")) <= F.lit(float(k)) * F.col("scale")
    inliers = attach(samples, whole, keys, "inner", "value").where(near).select(*samples.columns)
    clean = median_mad(inliers, keys).select(*keys, F.col("n").alias("_n"), F.col("median").alias("_median"), F.col("scale").alias("_scale"))
    moments = samples.groupBy(*keys).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    wide = moments.join(whole, keys).join(clean, keys, "left")
    enough, cleaned = F.col("count") >= min_samples, F.coalesce(F.col("_n") >= 3, F.lit(False))
    pick = lambda name: F.when(cleaned, F.col(f"_{name}")).otherwise(F.col(name))
    return wide.select(*keys, "count", *[F.when(enough, c).alias(n) for n, c in (("median", pick("median")), ("scale", pick("scale")), ("mean", F.col("mean")), ("std", F.col("std")))])
