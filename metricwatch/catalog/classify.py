"""Queries: autocorrelation, stationarity, trends, series classes and routing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from metricwatch.catalog.prepare import pts
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.catalog.statistics import rounded, rounded_sql
from metricwatch.functions.numeric import lookup_interpolate, lookup_interpolate_sql, normal_cdf, normal_cdf_sql, q, q_sql
from metricwatch.operators import correlation, features, hypothesis, prepare
from metricwatch.operators.ordered import row_index
from metricwatch.options import ClassifierOptions
from metricwatch.plans import classify
from metricwatch.sources.points import read_daily_orders, read_events


def daily(spark, folder):
    return read_daily_orders(spark, folder)


def acf_ctes(src: str, lags: str) -> tuple:
    """`acf(series_id, lag, acf, n)` over `src(series_id, rn, value)` for a list of lags."""
    return (
        ("am", f"SELECT series_id, avg(value) AS mu, count(*) AS n, sum((value - 0) * 0) AS z FROM {src} GROUP BY 1"),
        ("ax", f"SELECT s.series_id, rn, am.n, value - mu AS x FROM {src} s JOIN am USING (series_id)"),
        ("a0", "SELECT series_id, sum(x * x) AS c0 FROM ax GROUP BY 1"),
        ("al", f"SELECT unnest({lags}) AS lag"),
        ("ap", "SELECT a.series_id, lag, any_value(a.n) AS n, sum(a.x * b.x) AS c FROM ax a, al JOIN ax b "
               "ON b.series_id = a.series_id AND b.rn = a.rn - lag GROUP BY 1, 2"),
        ("acf", "SELECT series_id, CAST(lag AS BIGINT) AS lag, c / c0 AS acf, n FROM ap JOIN a0 USING (series_id)"),
    )


@query(
    "lagged_pairs",
    with_ctes("didx") + f"SELECT a.series_id, CAST(lag AS BIGINT) AS lag, count(*) AS pairs, {q_sql('sum((a.value / 1e6) * (b.value / 1e6))', 4)} AS product "
    "FROM didx a, (SELECT unnest([1, 7, 30]) AS lag) JOIN didx b ON b.series_id = a.series_id AND b.rn = a.rn - lag GROUP BY 1, 2",
)
def lagged_pairs(spark, folder):
    rows = row_index(daily(spark, folder)).withColumn("value", F.col("value") / 1e6)
    return rounded(correlation.lag_products(rows, [1, 7, 30]), "product", keep=("series_id", "lag", "pairs"), digits=4)


@query(
    "acf_vector",
    with_ctes("idx", *acf_ctes("idx", "range(0, 49)"))
    + f"SELECT series_id, lag, {q_sql('greatest(least(acf, 1.0), -1.0)')} AS acf FROM acf",
)
def acf_vector(spark, folder):
    vector = correlation.acf_vector(row_index(pts(spark, folder)), 48)
    return vector.select("series_id", F.posexplode("acf").alias("lag", "acf")).select(
        "series_id", F.col("lag").cast("long").alias("lag"), q("acf").alias("acf"))


@query(
    "adf_test",
    with_ctes(
        "didx",
        ("l", "SELECT series_id, value - lag(value) OVER w AS y, lag(value) OVER w AS x, lag(value) OVER w - lag(value, 2) OVER w AS z FROM didx WINDOW w AS (PARTITION BY series_id ORDER BY rn)"),
        ("s", "SELECT series_id, count(*) AS m, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(z, y) AS zy FROM l WHERE z IS NOT NULL GROUP BY 1"),
        ("b", "SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS beta, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS gamma FROM s"),
        ("t", "SELECT series_id, beta / sqrt((yy - beta * xy - gamma * zy) / (m - 3) * zz / det) AS adf FROM b"),
    )
    + f"SELECT series_id, {q_sql('adf')} AS adf, {q_sql(lookup_interpolate_sql('adf', hypothesis.ADF_TABLE))} AS adf_p FROM t",
)
def adf_test(spark, folder):
    return rounded(hypothesis.adf(row_index(daily(spark, folder))), "adf", "adf_p")


KPSS = (
    ("km", "SELECT series_id, avg(value) AS mu, count(*) AS n FROM didx GROUP BY 1"),
    ("kb", "SELECT *, CAST(least(greatest(floor(4.0 * (n / 100.0) ** (2.0 / 9.0)), 1), n - 1) AS BIGINT) AS bw FROM km"),
    ("kx", "SELECT series_id, rn, value - mu AS x, kb.n, bw FROM didx JOIN kb USING (series_id)"),
    ("ks", "SELECT series_id, n, bw, x, sum(x) OVER (PARTITION BY series_id ORDER BY rn) AS s FROM kx"),
    ("kp", "SELECT series_id, any_value(n) AS n, sum(s * s) AS ss, sum(x * x) / any_value(n) AS g0 FROM ks GROUP BY 1"),
    ("kl", "SELECT a.series_id, sum(2.0 * (1.0 - lag / (a.bw + 1.0)) * a.x * b.x / a.n) AS g FROM kx a JOIN (SELECT unnest(range(1, 50)) AS lag) ON lag <= a.bw "
           "JOIN kx b ON b.series_id = a.series_id AND b.rn = a.rn - lag GROUP BY 1"),
    ("kt", "SELECT series_id, ss / (CAST(n AS DOUBLE) * n * (g0 + g)) AS kpss FROM kp JOIN kl USING (series_id)"),
)


@query(
    "kpss_test",
    with_ctes("didx", *KPSS) + f"SELECT series_id, {q_sql('kpss')} AS kpss, {q_sql(lookup_interpolate_sql('kpss', hypothesis.KPSS_TABLE))} AS kpss_p FROM kt",
)
def kpss_test(spark, folder):
    return rounded(hypothesis.kpss(row_index(daily(spark, folder))), "kpss", "kpss_p")


@query(
    "stationarity_verdicts",
    "WITH c AS (SELECT c_custkey, -6.0 + (c_custkey % 97) / 10.0::DOUBLE AS adf, (c_custkey % 53) / 25.0::DOUBLE AS kpss FROM customer), "
    f"p AS (SELECT c_custkey, {lookup_interpolate_sql('adf', hypothesis.ADF_TABLE)} AS adf_p, {lookup_interpolate_sql('kpss', hypothesis.KPSS_TABLE)} AS kpss_p FROM c) "
    f"SELECT c_custkey, {rounded_sql(['adf_p', 'kpss_p'])}, adf_p < 0.05 AS by_adf, kpss_p > 0.05 AS by_kpss, adf_p < 0.05 AND kpss_p > 0.05 AS by_both, "
    "adf_p < 0.05 OR kpss_p > 0.05 AS by_either FROM p",
)
def stationarity_verdicts(spark, folder):
    """p-values by table look-up and the four ways to combine them."""
    c = spark.read.parquet(f"{folder}/customer.parquet").select(
        "c_custkey", (F.lit(-6.0) + (F.col("c_custkey") % 97) / F.lit(10.0)).alias("adf"), ((F.col("c_custkey") % 53) / F.lit(25.0)).alias("kpss"))
    p = c.withColumn("adf_p", lookup_interpolate(F.col("adf"), hypothesis.ADF_TABLE)).withColumn(
        "kpss_p", lookup_interpolate(F.col("kpss"), hypothesis.KPSS_TABLE))
    return p.select("c_custkey", q("adf_p").alias("adf_p"), q("kpss_p").alias("kpss_p"),
                    *[hypothesis.is_stationary(m).alias(f"by_{m}") for m in ("adf", "kpss", "both", "either")])


TREND = (
    ("ts0", "SELECT series_id, count(*) AS n, avg(value) AS mu, var_pop(rn) AS xx, var_pop(value) AS yy, covar_pop(rn, value) AS xy FROM didx GROUP BY 1"),
    ("ts1", "SELECT *, xy / xx AS slope, xy * xy / (xx * yy) AS r_squared FROM ts0"),
    ("ts2", "SELECT *, slope / sqrt((1 - r_squared) * yy / (n - 2) / xx) AS t_statistic FROM ts1"),
    ("tr", f"SELECT *, 2.0 * (1.0 - {normal_cdf_sql('abs(t_statistic)')}) AS p_value, tanh(abs(slope) * n / abs(mu)) AS strength, "
           "CASE WHEN slope > 0.01 THEN 1 WHEN slope < -0.01 THEN -1 ELSE 0 END AS direction FROM ts2"),
)


@query(
    "linear_trend",
    with_ctes("didx", *TREND) + f"SELECT series_id, n, direction, {q_sql('slope', 3)} AS slope, {rounded_sql(['r_squared', 't_statistic', 'p_value', 'strength'])} FROM tr",
)
def linear_trend(spark, folder):
    fit = hypothesis.linear_trend(row_index(daily(spark, folder))).withColumn("slope", q("slope", 3))
    return rounded(fit, "r_squared", "t_statistic", "p_value", "strength", keep=("series_id", "n", "slope", "direction"))


@query(
    "mann_kendall",
    with_ctes(
        "raw", ("h", "SELECT series_id, ts // 21600 AS k, floor(max(value)) AS value FROM raw GROUP BY 1, 2"),
        ("p", "SELECT a.series_id, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM h a JOIN h b ON b.series_id = a.series_id AND a.k < b.k GROUP BY 1"),
        ("n", "SELECT series_id, count(*) AS n FROM h GROUP BY 1"),
        ("z", "SELECT series_id, n, s, CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1.0) * (2.0 * n + 5) / 18) WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1.0) * (2.0 * n + 5) / 18) ELSE 0 END AS z FROM p JOIN n USING (series_id)"),
    )
    + f"SELECT series_id, n, s, {q_sql('z')} AS z, {q_sql('2.0 * (1.0 - ' + normal_cdf_sql('abs(z)') + ')')} AS p_value, CAST(sign(s) AS INT) AS direction FROM z",
)
def mann_kendall(spark, folder):
    points = prepare.resample(read_events(spark, folder), 21_600, "max").withColumn("value", F.floor("value").cast("double"))
    return rounded(hypothesis.mann_kendall(row_index(points)), "z", "p_value", keep=("series_id", "n", "s", "direction"))


@query(
    "normal_cdf",
    f"SELECT c_custkey, {q_sql(normal_cdf_sql('((c_acctbal - 4500) / 2000)'), 9)} AS p FROM customer",
)
def normal_cdf_query(spark, folder):
    x = (F.col("c_acctbal") - 4_500) / 2_000
    return spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", q(normal_cdf(x), 9).alias("p"))


SEASON = ClassifierOptions(candidate_periods=(7, 24, 48, 168, 30, 52))


def season_ctes() -> tuple:
    return (
        *acf_ctes("didx", "[7, 24, 48, 168, 30, 52]"),
        ("sk", "SELECT series_id, lag, list_position([7, 24, 48, 168, 30, 52], lag) AS o, least(abs(acf), 1.0) AS s FROM acf WHERE n >= 672 AND n >= 2 * lag AND abs(acf) > 0.02"),
        ("se", "SELECT series_id, list(CAST(lag AS INT) ORDER BY o) AS periods, avg(s) AS strength FROM sk GROUP BY 1"),
    )


@query(
    "seasonality",
    with_ctes("didx", *season_ctes()) + f"SELECT series_id, array_to_string(periods, ',') AS periods, {q_sql('strength')} AS strength FROM se",
)
def seasonality(spark, folder):
    found = classify.seasonality(row_index(daily(spark, folder)), replace(SEASON, acf_floor=0.02))
    return found.select("series_id", F.array_join("periods", ",").alias("periods"), q("strength").alias("strength"))


MA = (
    ("hr", "SELECT series_id, ts // 3600 * 3600 AS ts, avg(value) + 40 * sin((ts // 3600 * 3600) * pi() / 43200) AS value FROM raw GROUP BY 1, 2"),
    ("hx", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn FROM hr"),
)


def wavy(spark, folder):
    """Hourly means with a daily wave on top, so that there is a period to find."""
    hourly = prepare.resample(read_events(spark, folder), 3_600)
    wave = F.sin(F.col("ts") * F.lit(3.141592653589793) / 43_200) * 40
    return row_index(hourly.withColumn("value", F.col("value") + wave))


@query(
    "periodicity",
    with_ctes(
        "raw", *MA, *acf_ctes("hx", "range(0, 169)"),
        ("pk", "SELECT series_id, lag, acf, lag(acf) OVER w AS l, lead(acf) OVER w AS r FROM acf WHERE lag <= n // 2 WINDOW w AS (PARTITION BY series_id ORDER BY lag)"),
        ("pr", "SELECT series_id, lag, acf, row_number() OVER (PARTITION BY series_id ORDER BY acf DESC, lag) AS r FROM pk WHERE acf > l AND acf > r AND acf > 0.2"),
    ) + f"SELECT series_id, CAST(r AS INT) AS rank, CAST(lag AS INT) AS period, {q_sql('acf')} AS power FROM pr WHERE r <= 5",
)
def periodicity(spark, folder):
    found = classify.periodicity(wavy(spark, folder), 168)
    return found.select("series_id", F.posexplode(F.arrays_zip("periods", "powers")).alias("rank", "x")).select(
        "series_id", (F.col("rank") + 1).alias("rank"), F.col("x.periods").alias("period"), q("x.powers").alias("power"))


def circular_ctes(src: str, max_lag: int) -> tuple:
    return (
        ("cr", f"SELECT series_id, rn, value - avg(value) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x FROM {src}"),
        ("cx", "SELECT series_id, rn - 1 AS pos, x, count(*) OVER (PARTITION BY series_id) AS n FROM cr WHERE rn >= 1"),
        ("cc", f"SELECT a.series_id, CAST(lag AS BIGINT) AS lag, sum(a.x * b.x) / any_value(a.n) AS ac FROM cx a JOIN (SELECT unnest(range(0, {max_lag + 1})) AS lag) ON lag < a.n "
               "JOIN cx b ON b.series_id = a.series_id AND b.pos = (a.pos + lag) % a.n GROUP BY 1, 2"),
    )


@query(
    "circular_autocorrelation",
    with_ctes("raw", *MA, *circular_ctes("hx", 100_000)) + f"SELECT series_id, lag, {q_sql('ac')} AS ac FROM cc",
)
def circular_autocorrelation(spark, folder):
    residual = features.trailing_residual(wavy(spark, folder), 2)
    return rounded(correlation.circular_autocorrelation(residual, "residual"), "ac", keep=("series_id", "lag"))


def peak_ctes(threshold: float) -> tuple:
    return (
        ("mx", "SELECT series_id, max(ac) AS top FROM cc WHERE lag > 0 GROUP BY 1"),
        ("nb", "SELECT series_id, lag, ac, lag(ac) OVER w AS l, lead(ac) OVER w AS r FROM cc WINDOW w AS (PARTITION BY series_id ORDER BY lag)"),
        ("pk", f"SELECT nb.* FROM nb JOIN mx USING (series_id) WHERE ac > l AND ac > r AND ac >= {threshold} * top"),
    )


@query(
    "peak_periods",
    with_ctes(
        "raw", *MA, *circular_ctes("hx", 336), *peak_ctes(0.5),
        ("g1", "SELECT series_id, 'neighbours' AS how, lag - lag(lag) OVER (PARTITION BY series_id ORDER BY lag) AS interval FROM pk"),
        ("g2", "SELECT a.series_id, 'all_pairs' AS how, b.lag - a.lag AS interval FROM pk a JOIN pk b ON a.series_id = b.series_id AND a.lag < b.lag"),
        ("gc", "SELECT series_id, how, interval, count(*) AS frequency FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) WHERE interval BETWEEN 1 AND 168 GROUP BY 1, 2, 3"),
        ("gr", "SELECT *, row_number() OVER (PARTITION BY series_id, how ORDER BY frequency DESC, interval) AS rank FROM gc"),
    ) + "SELECT series_id, how, interval AS period, frequency, CAST(rank AS INT) AS rank FROM gr WHERE rank <= 3",
)
def peak_periods(spark, folder):
    """Periods from the spacing of significant peaks, by neighbours and by all pairs."""
    residual = features.trailing_residual(wavy(spark, folder), 2)
    ac = correlation.circular_autocorrelation(residual, "residual", 336)
    found = correlation.peaks(ac, "ac", F.col("top") * 0.5)
    out = None
    for how, pairs in (("neighbours", False), ("all_pairs", True)):
        top = correlation.top_periods(correlation.peak_intervals(found, pairs), 3, 1, 168).withColumn("how", F.lit(how))
        out = top if out is None else out.unionByName(top)
    return out.select("series_id", "how", "period", "frequency", "rank")


def _classes(spark, folder):
    return classify.classify(daily(spark, folder), SEASON)


@query(
    "classify_series",
    with_ctes(
        "didx", *KPSS, *TREND, *acf_ctes("didx", "range(0, 169)"),
        ("dl", "SELECT series_id, value - lag(value) OVER w AS y, lag(value) OVER w AS x, lag(value) OVER w - lag(value, 2) OVER w AS z FROM didx WINDOW w AS (PARTITION BY series_id ORDER BY rn)"),
        ("ds", "SELECT series_id, count(*) AS m, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(z, y) AS zy FROM dl WHERE z IS NOT NULL GROUP BY 1"),
        ("db", "SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS beta, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS gamma FROM ds"),
        ("da", "SELECT series_id, beta / sqrt((yy - beta * xy - gamma * zy) / (m - 3) * zz / det) AS adf FROM db"),
        ("pv", f"SELECT series_id, {lookup_interpolate_sql('adf', hypothesis.ADF_TABLE)} AS adf_p, {lookup_interpolate_sql('kpss', hypothesis.KPSS_TABLE)} AS kpss_p FROM da JOIN kt USING (series_id)"),
        ("sn", "SELECT series_id, count(*) AS k FROM acf WHERE lag IN (7, 24, 48, 168, 30, 52) AND n >= 672 AND abs(acf) > 0.1 GROUP BY 1"),
        ("pk", "SELECT series_id, lag, acf, lag(acf) OVER w AS l, lead(acf) OVER w AS r FROM acf WHERE lag <= n // 2 WINDOW w AS (PARTITION BY series_id ORDER BY lag)"),
        ("cy", "SELECT series_id, count(*) AS c FROM pk WHERE acf > l AND acf > r AND acf > 0.2 GROUP BY 1"),
        ("dd", "SELECT series_id, stddev_samp(value) / abs(avg(value)) AS cv FROM didx GROUP BY 1"),
        ("j", "SELECT *, adf_p < 0.05 AND kpss_p > 0.05 AS st, coalesce(k, 0) > 0 AS sea, coalesce(c, 0) > 0 AS cyc FROM dd JOIN pv USING (series_id) JOIN tr USING (series_id) LEFT JOIN sn USING (series_id) LEFT JOIN cy USING (series_id)"),
        ("kd", "SELECT *, CASE WHEN cv > 0.8 THEN 'irregular' WHEN st AND sea THEN 'seasonal' WHEN st THEN 'stationary' WHEN sea THEN 'seasonal_trend' ELSE 'trending' END AS kind, "
               "CASE WHEN cv > 0.8 THEN 0.3 WHEN st AND sea THEN 0.85 WHEN st AND cyc THEN 0.7 WHEN st THEN 0.9 WHEN sea THEN 0.85 ELSE 0.8 END AS confidence FROM j"),
    )
    + "SELECT series_id, kind, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN kind IN ('trending', 'seasonal_trend') THEN CASE WHEN direction > 0 THEN 'up' ELSE 'down' END END AS heading, "
    f"{rounded_sql(['cv', 'adf_p', 'kpss_p'])} FROM kd",
)
def classify_series(spark, folder):
    return rounded(_classes(spark, folder), "cv", "adf_p", "kpss_p", keep=("series_id", "kind", "confidence", "heading"))


@query(
    "classify_by_slope",
    with_ctes("didx", *TREND, ("k", "SELECT series_id, n >= 10 AND abs(slope * n) / sqrt(yy) >= 1.0 AS tilted, slope, series_id < '3' AS sea FROM tr"))
    + "SELECT series_id, CASE WHEN sea AND tilted THEN 'seasonal_trend' WHEN sea THEN 'seasonal' WHEN tilted THEN 'trending' ELSE 'stationary' END AS kind, "
    "CASE WHEN tilted THEN CASE WHEN slope > 0 THEN 'up' ELSE 'down' END END AS heading FROM k",
)
def classify_by_slope(spark, folder):
    points = daily(spark, folder)
    known = points.where(F.col("series_id") < "3").select("series_id", F.array(F.lit(7)).alias("periods")).distinct()
    return classify.classify_by_slope(points, known).select("series_id", "kind", "heading")


@query(
    "route_detector",
    "WITH c AS (SELECT c_custkey, ['stationary', 'trending', 'seasonal', 'seasonal_trend', 'irregular'][c_custkey % 5 + 1] AS kind, (c_custkey % 40) / 20.0 - 1.0 AS skew FROM customer) "
    "SELECT c_custkey, kind, CASE WHEN kind IN ('stationary', 'seasonal') THEN 'outlier' WHEN kind = 'irregular' THEN 'baseline' ELSE 'forecast' END AS method, "
    "CASE WHEN kind IN ('stationary', 'seasonal') THEN CASE WHEN abs(skew) < 0.5 THEN 'mad' WHEN abs(skew) < 1.0 THEN 'iqr' ELSE 'evt' END END AS threshold, "
    "kind IN ('trending', 'seasonal_trend') AS detrend, kind IN ('seasonal', 'seasonal_trend') AS deseasonalize, kind = 'stationary' AS normalize, "
    "kind = 'irregular' AS median_filter, kind NOT IN ('stationary', 'seasonal') AS requires_history, CASE WHEN kind = 'irregular' THEN 3.0 ELSE 2.0 END::DOUBLE AS std_dev_multiplier, "
    "CASE WHEN kind IN ('seasonal', 'seasonal_trend') THEN 2 ELSE 0 END AS n_periods FROM c",
)
def route_detector(spark, folder):
    kinds = F.array(*[F.lit(k) for k in ("stationary", "trending", "seasonal", "seasonal_trend", "irregular")])
    c = spark.read.parquet(f"{folder}/customer.parquet").select(
        "c_custkey", F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int")).alias("kind"),
        ((F.col("c_custkey") % 40) / F.lit(20.0) - 1.0).alias("skew"))
    decision = classify.route(F.col("kind"), F.col("skew"), F.array(F.lit(7), F.lit(24)), F.lit(0.85))
    wide = c.withColumn("d", decision).select("c_custkey", "kind", "d.*")
    return wide.withColumn("n_periods", F.size("periods")).drop("periods", "confidence")
