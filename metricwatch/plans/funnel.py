"""The funnel: a cheap seasonal filter decides most points, models only see the undecided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.functions import season
from metricwatch.operators.aggregates import population_skewness, threshold_method
from metricwatch.operators.joins import attach, attach_checked
from metricwatch.operators.prepare import eval_window, missing_gate
from metricwatch.operators.quantiles import MAD_SIGMA
from metricwatch.operators.robust_buckets import bucket_stats
from metricwatch.options import FunnelOptions
from metricwatch.plans import profile
from metricwatch.plans.dynamics import RESULT, blended, flag_outside, with_neighbours
from metricwatch.session import cut_lineage

IQR_FACTOR = 1.5
FLAT_SCALE, FLAT_WIDTH = 1e-12, 1e-9
L1_COLUMNS = (
    "series_id", "ts", "value", "baseline", "lower_bound", "upper_bound", "inner_lower", "inner_upper", "verdict",
)


def l1_methods(history: DataFrame) -> DataFrame:
    """Threshold rule per series from the skewness of its whole history."""
    skew = history.groupBy("series_id").agg(population_skewness("value").alias("skew"))
    return skew.withColumn("method", threshold_method(F.col("skew"), "zscore"))


def l1_buckets(meta: DataFrame, samples: DataFrame, options: FunnelOptions) -> DataFrame:
    """Bucket rows with their statistics, those of both neighbours, and the series' bucket layout."""
    stats = bucket_stats(samples, options.hampel_k, options.min_samples)
    layout = meta.select("series_id", "effective_trend", "slot_secs")
    seasonal = F.col("effective_trend") != "none"
    wide = stats.join(layout, "series_id")
    for c in ("median", "scale"):
        wide = wide.withColumn(c, F.when(seasonal, F.col(c)))
    return with_neighbours(
        wide, ["median", "scale", "mean", "std"], season.bucket_count(F.col("effective_trend"), F.col("slot_secs"))
    ).drop("effective_trend", "slot_secs")


def l1_filter(
    current: DataFrame,
    meta: DataFrame,
    buckets: DataFrame,
    methods: DataFrame,
    options: FunnelOptions = FunnelOptions(),
) -> DataFrame:
    """Normal inside the inner band, anomaly outside the outer one, uncertain between.

    The band comes from the bucket's median and MAD; without those from mean and std. A value
    or a bucket that is missing leaves the point uncertain, with NULL bounds.
    """
    layout = meta.select("series_id", "effective_trend", "slot_secs").join(
        methods.select("series_id", "method"), "series_id", "left"
    )
    keyed = attach_checked(current, layout).withColumn(
        "bucket", season.season_key(F.col("ts"), F.col("effective_trend"), F.col("slot_secs"))
    )
    blend = F.when(F.col("effective_trend") == "none", F.lit(0)).otherwise(F.lit(options.transition_secs))
    w_prev, w_next = season.blend_weights(F.col("ts"), F.col("slot_secs"), blend)
    wide = attach_checked(keyed, buckets, ["series_id", "bucket"]).withColumn("_wp", w_prev).withColumn("_wn", w_next)
    robust = F.col("median").isNotNull()
    spread = blended("std") * F.when(F.col("method") == "mad", MAD_SIGMA).otherwise(1.0)
    center = F.when(robust, blended("median")).otherwise(blended("mean"))
    scale = F.when(robust, blended("scale")).otherwise(spread)
    factor = F.when(F.col("method") == "iqr", F.lit(IQR_FACTOR)).otherwise(F.lit(1.0))
    flat = F.col("_scale") <= FLAT_SCALE

    def half(k: float) -> Column:
        return F.when(flat, F.lit(FLAT_WIDTH)).otherwise(F.lit(k) * F.col("_scale") * factor)

    known = F.col("value").isNotNull()
    x, b = F.col("value"), F.col("baseline")
    outer, inner = half(options.k_outer), half(options.k_inner)
    outside = (x < b - outer) | (x > b + outer)
    inside = (x >= b - inner) & (x <= b + inner)
    return (
        wide.withColumn("baseline", F.when(known, center))
        .withColumn("_scale", F.when(known, scale))
        .withColumn("lower_bound", b - outer).withColumn("upper_bound", b + outer)
        .withColumn("inner_lower", b - inner).withColumn("inner_upper", b + inner)
        .withColumn(
            "verdict",
            F.when(b.isNull(), "uncertain").when(outside, "anomaly").when(inside, "normal").otherwise("uncertain"),
        )
        .select(*[c for c in current.columns if c not in L1_COLUMNS], *L1_COLUMNS)
    )


def l1_metrics(verdicts: DataFrame) -> DataFrame:
    """Split counts, share of decided points and share handed to the second level, per series."""
    counts = verdicts.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(f"l1_{v}") for v in ("normal", "anomaly", "uncertain")],
    )
    return counts.withColumn(
        "coverage", (F.col("l1_normal") + F.col("l1_anomaly")) / F.col("total")
    ).withColumn("escalation", F.col("l1_uncertain") / F.col("total"))


def merge_levels(l1: DataFrame, l2: DataFrame) -> DataFrame:
    """Second-level results replace the uncertain rows; decided rows keep theirs.

    `l2` has `series_id, ts, l2_baseline, l2_lower, l2_upper, l2_anomaly`; an outlier result has
    no bounds, and then the first level's stay.
    """
    open_row = (F.col("verdict") == "uncertain") & F.col("l2_anomaly").isNotNull()
    decided = F.when(F.col("verdict") == "anomaly", 1).otherwise(0)
    merged = l1.join(l2, ["series_id", "ts"], "left").withColumn(
        "anomaly", F.when(open_row, F.col("l2_anomaly")).otherwise(decided).cast("int")
    )
    for name, other in (("baseline", "l2_baseline"), ("lower_bound", "l2_lower"), ("upper_bound", "l2_upper")):
        merged = merged.withColumn(name, F.when(open_row, F.coalesce(other, name)).otherwise(F.col(name)))
    return merged.drop("l2_baseline", "l2_lower", "l2_upper", "l2_anomaly")


def shape_alerts(result: DataFrame, mode: str, alerted: DataFrame | None = None) -> DataFrame:
    """`full` keeps all flags, `latest_only` each series' newest, `dedupe` those not alerted before."""
    if mode == "latest_only":
        newest = result.where(F.col("anomaly") == 1).groupBy("series_id").agg(F.max("ts").alias("_newest"))
        keep = (F.col("anomaly") == 1) & (F.col("ts") == F.col("_newest"))
        return attach(result, newest).withColumn("anomaly", F.coalesce(keep.cast("int"), F.lit(0))).drop("_newest")
    if mode == "dedupe" and alerted is not None:
        seen = alerted.select("series_id", "ts", F.lit(True).alias("_seen")).distinct()
        fresh = F.col("_seen").isNull()
        return result.join(seen, ["series_id", "ts"], "left").withColumn(
            "anomaly", F.when(fresh, F.col("anomaly")).otherwise(F.lit(0))
        ).drop("_seen")
    return result


def score(
    current: DataFrame, history: DataFrame, meta: DataFrame, samples: DataFrame, methods: DataFrame, options: FunnelOptions = FunnelOptions(),
) -> DataFrame:
    """Verdicts, bands and flags of the current points under a profile that does not hold them.

    Points outside the evaluation window, and those of a series that the gate holds back, are shown
    with their own value, no band and no verdict. `history` serves the second level only.
    """
    gates = missing_gate(current, options.max_missing_rate, zeros=2.0).select("series_id", "gate")
    rows = attach(eval_window(current, options.eval_window_secs), gates)
    checked = F.col("in_eval") & (F.col("gate") != "missing")
    l1 = l1_filter(rows.where(checked), meta, l1_buckets(meta, samples, options), methods, options)
    if options.enable_l2:
        from metricwatch.plans.escalate import second_level

        l1 = cut_lineage(l1)  # every detector of the second level reads it
        scored = merge_levels(l1, second_level(l1, history, meta, options))
    else:
        # The flag follows the band that is shown; an uncertain point is no anomaly.
        scored = l1.withColumn("anomaly", flag_outside(F.col("value"), F.col("lower_bound"), F.col("upper_bound")))
    shown = rows.where(~checked).select("series_id", "ts", "value", F.col("value").alias("baseline"), F.lit(0).alias("anomaly"))
    return scored.select(*L1_COLUMNS, "anomaly").unionByName(shown, allowMissingColumns=True)


def detect_funnel(
    current: DataFrame,
    history: DataFrame,
    options: FunnelOptions = FunnelOptions(),
    stored: tuple[DataFrame, DataFrame] | None = None,
    alerted: DataFrame | None = None,
) -> DataFrame:
    """Flags and bands for the current points of every series.

    `stored` is a saved profile `(meta, samples)`; without it one is built from history.
    """
    meta, samples = stored or profile.build_profile(history, options)
    clean = profile.without_points(samples, current) if stored else samples
    result = score(current, history, meta, clean, l1_methods(history), options).select(*RESULT)
    if options.effective_alert_mode == "latest_only":
        result = cut_lineage(result)  # read twice: for the newest alert and for the rows
    return shape_alerts(result, options.effective_alert_mode, alerted)
