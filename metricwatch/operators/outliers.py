"""Outlier flags per series: MAD, IQR and extreme-value fences, chosen by skewness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from metricwatch.operators.aggregates import (
    normal_density_skewness, population_skewness, threshold_method,
)
from metricwatch.operators.joins import attach_checked, salt
from metricwatch.operators.ordered import rolling
from metricwatch.operators.prepare import missing_gate
from metricwatch.operators.quantiles import exact_quantiles, floored_scale
from metricwatch.session import cut_lineage

ZERO_RATE = 0.3  # a series with a larger share of zeros and missing values gets no flags

# Fixed values of the detector.
MAD_K, IQR_K = 3.0, 1.5
EVT_TAIL, EVT_TOP, EVT_MIN_ROWS = 0.1, 10, 20
SCORE_HIGH_SKEW, SCORE_MEDIUM_SKEW = 1.0, 0.8
ROLLING_ROWS, ROLLING_K, ROLLING_RANGE = 5, 2.0, (0.01, 0.99)


def evt_fit(scores: DataFrame, score: str = "score", top: int = EVT_TOP) -> DataFrame:
    """Exponential tail per series: the smallest of the `top` scores and their mean excess.

    The ranking keeps `top` rows per series and task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(score)))
    best = scores.select("series_id", score).withColumn("_r", rank).where(F.col("_r") <= top)
    return best.groupBy("series_id").agg(
        F.min(score).alias("evt_start"),
        (F.avg(score) - F.min(score)).alias("evt_excess"),
        F.count(F.lit(1)).alias("_kept"),
    ).where(F.col("_kept") == top).drop("_kept")


def evt_flag(score: Column) -> Column:
    """1 where the tail probability beyond the start is below EVT_TAIL."""
    over = score - F.col("evt_start")
    unlikely = F.exp(-over / F.col("evt_excess")) < EVT_TAIL
    return F.coalesce(((over > 0) & (F.col("evt_excess") > 0) & unlikely).cast("int"), F.lit(0))


def robust_fences(points: DataFrame, value: str = "value") -> DataFrame:
    """Everything the three fences need, one row per series."""
    shape = points.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), population_skewness(value).alias("skew")
    )
    rows = salt(points.where(F.col(value).isNotNull()))
    quarts = exact_quantiles(rows, ["series_id"], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    quarts = cut_lineage(quarts)
    away = attach_checked(rows, quarts.drop("n"), how="inner").withColumn("score", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(away, ["series_id"], "score", {"_mad": 0.5}).drop("n")
    method = F.when(F.col("rows") < 3, "none").otherwise(
        F.when((threshold_method(F.col("skew")) == "evt") & (F.col("rows") < EVT_MIN_ROWS), "mad")
        .otherwise(threshold_method(F.col("skew")))
    )
    return (
        shape.join(quarts.drop("n"), "series_id", "left")
        .join(mad, "series_id", "left")
        .join(evt_fit(away), "series_id", "left")
        .withColumn("method", method)
        .withColumn("scale", floored_scale(F.col("_mad"), F.col("median")))
        .drop("_mad")
    )


def flag_columns(value: str = "value") -> dict[str, Column]:
    """Flags of each rule for points carrying the fences."""
    v, reach = F.col(value), F.lit(IQR_K) * (F.col("q3") - F.col("q1"))
    away = F.abs(v - F.col("median"))
    return {
        "mad": F.coalesce((away > MAD_K * F.col("scale")).cast("int"), F.lit(0)),
        "iqr": F.coalesce(((v < F.col("q1") - reach) | (v > F.col("q3") + reach)).cast("int"), F.lit(0)),
        "evt": evt_flag(away),
    }


def robust_flags(points: DataFrame, value: str = "value") -> DataFrame:
    """Flag outliers of each series by the rule its skewness selects."""
    flags = flag_columns(value)
    wide = attach_checked(points, robust_fences(points, value))
    picked = (
        F.when(F.col("method") == "mad", flags["mad"])
        .when(F.col("method") == "iqr", flags["iqr"])
        .when(F.col("method") == "evt", flags["evt"])
        .otherwise(F.lit(0))
    )
    return wide.withColumn("anomaly", picked).select(*points.columns, "method", "anomaly")


def gated(points: DataFrame, flags: DataFrame) -> DataFrame:
    """No flags for constant series and series with too many zeros; a missing value counts as zero.

    The gate's name is no help here: it says "missing" for a series that has too many zeros as well.
    """
    gates = missing_gate(points).select("series_id", ((F.col("zero_rate") > ZERO_RATE) | F.coalesce("constant", F.lit(False))).alias("_closed"))
    return attach_checked(flags, gates).withColumn("anomaly", F.when(F.col("_closed"), F.lit(0)).otherwise(F.col("anomaly"))).drop("_closed")


def split(x):
    """The upper 26 bits of a double, as a column or number; the rest is exact too."""
    wide = x * 134217729.0  # 2^27 + 1
    return wide - (wide - x)


def with_percentile(df: DataFrame, ordered: str, n: int, p: float, out: str) -> DataFrame:
    """Add the linear percentile of a sorted array of `n` values.

    Between two values it is `a * keep + b * part` with the first product not rounded, as SQL engines
    that use a fused multiply-add compute it: a value that lies on a band needs the same double. Spark
    has no such function, so what the product and the sum lose is computed and added.
    """
    h = (n - 1) * p
    lo = int(h)
    part, a, b = h - lo, F.get(ordered, F.lit(lo)), F.get(ordered, F.lit(lo + 1))
    if not part:
        return df.withColumn(out, a)
    keep = 1 - part
    kh = split(keep)
    kl = keep - kh
    # one step a column, so that nothing is computed twice
    df = df.withColumns({"_a": a, "_p": a * keep, "_b": b * part}).withColumns({"_ah": split(F.col("_a")), "_sum": F.col("_p") + F.col("_b")})
    df = df.withColumns({"_al": F.col("_a") - F.col("_ah"), "_shift": F.col("_sum") - F.col("_p")})
    ah, al, product, total, shift = (F.col(c) for c in ("_ah", "_al", "_p", "_sum", "_shift"))
    lack = ((ah * kh - product) + ah * kl + al * kh) + al * kl
    lost = (product - (total - shift)) + (F.col("_b") - shift)
    exact = F.greatest(F.abs("_a"), F.abs("_b")) < 1e290  # larger values overflow when split
    return df.withColumn(out, F.when(exact, total + (lost + lack)).otherwise(total)).drop("_a", "_p", "_b", "_ah", "_al", "_sum", "_shift")


def rolling_iqr_flags(
    indexed: DataFrame,
    value: str = "value",
    rows: int = ROLLING_ROWS,
    percentiles: tuple[float, float] = ROLLING_RANGE,
    k: float = ROLLING_K,
) -> DataFrame:
    """Flag a value outside the percentile band, widened by k·IQR, of the `rows` values before it."""
    def seen(w: WindowSpec) -> Column:
        return F.sort_array(F.collect_list(value).over(w.rowsBetween(-rows, -1)))

    wide, found = rolling(indexed, {"_seen": seen}, back=rows), {"_q1": 0.25, "_q3": 0.75, "_low": percentiles[0], "_high": percentiles[1]}
    for name, p in found.items():
        wide = with_percentile(wide, "_seen", rows, p, name)
    v, reach = F.col(value), F.lit(k) * (F.col("_q3") - F.col("_q1"))
    outside = (v < F.col("_low") - reach) | (v > F.col("_high") + reach)
    flag = F.when(F.col("rn") < rows, F.lit(0)).otherwise(outside.cast("int"))
    return wide.withColumn("rolling_flag", F.coalesce(flag, F.lit(0))).drop("_seen", *found)


def score_flags(indexed: DataFrame, value: str = "value", score: str = "score") -> DataFrame:
    """Flags from anomaly scores; the rule follows the skewness of the values' normal density."""
    skew = normal_density_skewness(indexed, value).select("series_id", F.abs("pdf_skew").alias("_k"))
    wide = attach_checked(rolling_iqr_flags(indexed, score), skew.join(evt_fit(indexed, score), "series_id", "left"))
    flag = (
        F.when(F.col("_k") >= SCORE_HIGH_SKEW, evt_flag(F.col(score)))
        .when(F.col("_k") >= SCORE_MEDIUM_SKEW, F.col("rolling_flag"))
        .otherwise(F.lit(0))
    )
    return wide.withColumn("anomaly", flag).select(*indexed.columns, "anomaly")
