"""Queries: buckets, slices, resampling, gates and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricwatch.catalog.dynamics import T0
from metricwatch.catalog.registry import query, with_ctes
from metricwatch.functions import season
from metricwatch.functions.calendar import FEATURES, calendar_features
from metricwatch.functions.numeric import confidence_multiplier, lookup_interpolate_sql, q, q_sql
from metricwatch.functions.numeric import CONFIDENCE_TABLE
from metricwatch.operators import prepare
from metricwatch.operators.ordered import row_index
from metricwatch.sources.points import canonical, epoch_seconds, points_from_table, read_daily_orders, read_events

DAY = 86_400


def pts(spark, folder):
    return canonical(read_events(spark, folder))


# -- sources ---------------------------------------------------------------------------------

@query(
    "epoch_units",
    "WITH u AS (SELECT event_id, ts, unnest([0, 1, 2, 3]) AS unit FROM events), "
    "r AS (SELECT event_id, unit, CASE unit WHEN 0 THEN epoch(date_trunc('second', ts)) "
    "ELSE epoch(date_trunc('second', ts)) * [1.0, 1e3, 1e9][unit] END AS raw FROM u) "
    f"SELECT event_id, unit, {q_sql('CASE WHEN abs(raw) >= 1e15 THEN raw / 1e9 WHEN abs(raw) >= 1e11 THEN raw / 1e3 ELSE raw END', 3)} AS ts FROM r",
)
def epoch_units(spark, folder):
    """Timestamps, seconds, milliseconds and nanoseconds all become seconds."""
    events = read_events(spark, folder).select("event_id", F.col("ts").cast("double").alias("s"))
    units = F.array(
        F.struct(F.lit(0).alias("unit"), F.col("s").alias("raw")),
        F.struct(F.lit(1).alias("unit"), F.col("s").alias("raw")),
        F.struct(F.lit(2).alias("unit"), (F.col("s") * 1e3).alias("raw")),
        F.struct(F.lit(3).alias("unit"), (F.col("s") * 1e9).alias("raw")),
    )
    wide = events.select("event_id", F.explode(units).alias("u"))
    return wide.select("event_id", "u.unit", q(epoch_seconds(F.col("u.raw")), 3).alias("ts"))


@query(
    "points_from_text_column",
    "SELECT event_type AS series_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, "
    "coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE), 0.0) AS value FROM events",
)
def points_from_text_column(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    text = events.withColumn("value", F.regexp_extract("props", "[0-9]+", 0))
    return points_from_table(text, "event_type", "ts")


@query("canonical_points", with_ctes("pts") + "SELECT series_id, ts, value FROM pts")
def canonical_points(spark, folder):
    return pts(spark, folder)


@query(
    "every_12th_row",
    with_ctes("idx") + "SELECT series_id, ts, value FROM idx WHERE rn % 12 = 0",
)
def every_12th_row(spark, folder):
    return prepare.every_kth(row_index(pts(spark, folder)), 12).select("series_id", "ts", "value")


@query(
    "shift_to_date",
    with_ctes("raw") + "SELECT series_id, event_id, value, ts + (20073 - (SELECT max(ts) // 86400 FROM raw)) * 86400 AS ts FROM raw",
)
def shift_to_date(spark, folder):
    return prepare.shift_to(read_events(spark, folder), "2024-12-16")


# -- slices and splits -----------------------------------------------------------------------

@query(
    "time_slice",
    with_ctes("raw") + f"SELECT series_id, ts, value FROM raw WHERE ts >= {T0} AND ts < {T0 + DAY}",
)
def time_slice(spark, folder):
    points = read_events(spark, folder, "2024-01-24 00:00:00", "2024-01-25 00:00:00")
    return prepare.time_slice(points, T0, T0 + DAY).select("series_id", "ts", "value")


@query(
    "history_and_current",
    with_ctes("raw") + f"SELECT series_id, event_id, CASE WHEN ts < {T0} THEN 'history' ELSE 'current' END AS role "
    f"FROM raw WHERE ts >= {T0 - 7 * DAY} AND ts < {T0 + 2 * DAY}",
)
def history_and_current(spark, folder):
    points = read_events(spark, folder, "2024-01-17 00:00:00", "2024-01-26 00:00:00")
    return prepare.extend_back(points, T0, T0 + 2 * DAY).select("series_id", "event_id", "role")


CUT = "CASE WHEN n < 2 THEN NULL WHEN n < 20 THEN n // 2 ELSE least(greatest(CAST(floor(n * 0.7) AS BIGINT), 1), n - 1) END"
TAIL = "CASE WHEN n < 2 THEN NULL ELSE least(greatest(CAST(floor(n * 0.7) AS BIGINT), 1), n - 1) END"


@query(
    "cold_start_split",
    with_ctes("idx") + f"SELECT series_id, ts, CASE WHEN rn < {CUT} THEN 'history' WHEN rn >= {CUT} THEN 'current' END AS role FROM idx",
)
def cold_start_split(spark, folder):
    return prepare.cold_start_split(pts(spark, folder)).select("series_id", "ts", "role")


@query(
    "ensure_both_roles",
    with_ctes(
        "raw",
        ("p", "SELECT user_id || '/' || event_type AS series_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, "
              "arg_max(value, event_id) AS value FROM events GROUP BY 1, 2"),
        ("i", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn, count(*) OVER w AS n, "
              f"count_if(ts < {T0}) OVER w AS h, count_if(ts >= {T0}) OVER w AS c FROM p "
              "WINDOW w AS (PARTITION BY series_id)"),
        ("k", f"SELECT *, CASE WHEN h > 0 THEN {TAIL} ELSE {CUT} END AS cut FROM i"),
    )
    + f"SELECT series_id, ts, CASE WHEN h > 0 AND c > 0 THEN CASE WHEN ts < {T0} THEN 'history' ELSE 'current' END "
    "WHEN rn < cut THEN 'history' WHEN rn >= cut THEN 'current' END AS role FROM k",
)
def ensure_both_roles(spark, folder):
    series = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    points = canonical(read_events(spark, folder, series=series))
    split = points.withColumn("role", F.when(F.col("ts") < T0, "history").otherwise("current"))
    return prepare.ensure_roles(split).select("series_id", "ts", "role")


@query(
    "trailing_eval_window",
    with_ctes("raw") + "SELECT series_id, event_id, ts >= max(ts) OVER (PARTITION BY series_id) - 7200 AS in_eval FROM raw",
)
def trailing_eval_window(spark, folder):
    return prepare.eval_window(read_events(spark, folder), 7_200).select("series_id", "event_id", "in_eval")


@query(
    "resample_hourly",
    with_ctes("raw") + f"SELECT series_id, ts // 3600 * 3600 AS ts, {q_sql('avg(value)')} AS value, "
    "max(value) AS peak FROM raw GROUP BY 1, 2",
)
def resample_hourly(spark, folder):
    raw = read_events(spark, folder)
    mean = prepare.resample(raw, prepare.step_for(60, 30 * DAY, fixed_step=3_600))
    peak = prepare.resample(raw, 3_600, "max").withColumnRenamed("value", "peak")
    return mean.join(peak, ["series_id", "ts"]).withColumn("value", q("value"))


@query(
    "resample_to_budget",
    with_ctes("raw") + f"SELECT series_id, ts // 1728 * 1728 AS ts, {q_sql('avg(value)')} AS value FROM raw GROUP BY 1, 2",
)
def resample_to_budget(spark, folder):
    step = prepare.step_for(60, 30 * DAY, 1_500)
    return prepare.resample(read_events(spark, folder), step).withColumn("value", q("value"))


@query(
    "points_needed",
    with_ctes("raw", ("s", "SELECT series_id, max(ts) - min(ts) AS span FROM raw GROUP BY 1"))
    + "SELECT series_id, step, CAST(greatest(ceil(span / CAST(step AS DOUBLE)), 1) AS BIGINT) AS needed "
    "FROM s, (SELECT unnest([5, 60, 3600]) AS step)",
)
def points_needed(spark, folder):
    span = read_events(spark, folder).groupBy("series_id").agg((F.max("ts") - F.min("ts")).alias("span"))
    steps = span.select("series_id", "span", F.explode(F.array(F.lit(5), F.lit(60), F.lit(3_600))).alias("step"))
    needed = prepare.points_needed(F.col("span"), F.col("step")).cast("long")
    return steps.select("series_id", "step", needed.alias("needed"))


GAP = (
    "CASE WHEN a IS NULL OR ({to} <= {frm}) OR (b <= a) OR ({to} <= a) OR ({frm} >= b) THEN 'miss' "
    "WHEN {frm} < a AND {to} > b THEN 'extend_both' WHEN {frm} < a THEN 'extend_left' "
    "WHEN {to} > b THEN 'extend_right' ELSE 'cover' END"
)


@query(
    "gap_plan",
    with_ctes(
        "pts",
        ("s", f"SELECT series_id, min(ts) AS a, max(ts) + 1 AS b FROM pts WHERE ts >= {T0 - 5 * DAY} AND ts < {T0} GROUP BY 1"),
        ("w", f"SELECT unnest([{T0 - 2 * DAY}, {T0 - 3 * DAY}, {T0 - 9 * DAY}, {T0 - 9 * DAY}, {T0 + DAY}]) AS f, "
              f"unnest([{T0 - DAY}, {T0 + DAY}, {T0 - 2 * DAY}, {T0 + DAY}, {T0 + 2 * DAY}]) AS t"),
    )
    + f"SELECT series_id, f - {T0} AS f, t - {T0} AS t, {GAP.format(frm='f', to='t')} AS plan FROM s, w",
)
def gap_plan(spark, folder):
    stored = pts(spark, folder).where((F.col("ts") >= T0 - 5 * DAY) & (F.col("ts") < T0))
    span = stored.groupBy("series_id").agg(F.min("ts").alias("a"), (F.max("ts") + 1).alias("b"))
    asks = [(-2, -1), (-3, 1), (-9, -2), (-9, 1), (1, 2)]
    wanted = F.explode(F.array(*[F.struct(F.lit(f * DAY).alias("f"), F.lit(t * DAY).alias("t")) for f, t in asks]))
    rows = span.withColumn("w", wanted).select("series_id", "a", "b", "w.*")
    plan = prepare.gap_plan(F.col("a"), F.col("b"), F.col("f") + T0, F.col("t") + T0)
    return rows.select("series_id", "f", "t", plan.alias("plan"))


@query(
    "extend_stored_history",
    with_ctes("pts") + f"SELECT series_id, ts, value FROM pts WHERE ts >= {T0 - 9 * DAY} AND ts < {T0 + DAY}",
)
def extend_stored_history(spark, folder):
    """Stored points of five days, extended on both sides: the same as reading all ten."""
    points = pts(spark, folder)
    stored = prepare.time_slice(points, T0 - 5 * DAY, T0)
    return prepare.extend_history(stored, points, T0 - 9 * DAY, T0 + DAY)


@query(
    "union_points",
    with_ctes("raw", "daily") + "SELECT series_id, ts, value FROM raw UNION ALL SELECT series_id, ts, value FROM daily",
)
def union_points(spark, folder):
    return read_events(spark, folder).drop("event_id").unionByName(read_daily_orders(spark, folder))


HOURLY_GRID = (
    ("h", "SELECT series_id, ts // 3600 * 3600 AS ts, max(value) AS value FROM raw GROUP BY 1, 2"),
    ("g", "SELECT series_id, unnest(range(min(ts), max(ts) + 1, 3600)) AS ts FROM h GROUP BY 1"),
    ("f", "SELECT g.series_id, g.ts, h.value, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS rn "
          "FROM g LEFT JOIN h ON h.series_id = g.series_id AND h.ts = g.ts"),
)


def hourly_grid(spark, folder):
    hourly = prepare.resample(read_events(spark, folder), 3_600, "max")
    return row_index(prepare.regular_grid(hourly, 3_600))


@query(
    "interpolate_gaps",
    with_ctes(
        "raw", *HOURLY_GRID,
        ("m", "SELECT *, max(CASE WHEN value IS NOT NULL THEN rn END) OVER (PARTITION BY series_id ORDER BY rn) AS x0, "
              "min(CASE WHEN value IS NOT NULL THEN rn END) OVER (PARTITION BY series_id ORDER BY rn "
              "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM f"),
    )
    + "SELECT m.series_id, m.ts, m.value, "
    + q_sql("CASE WHEN m.value IS NOT NULL THEN m.value WHEN x1 > x0 THEN a.value + (b.value - a.value) / (x1 - x0) * (m.rn - x0) END")
    + " AS filled FROM m LEFT JOIN f a ON a.series_id = m.series_id AND a.rn = m.x0 "
    "LEFT JOIN f b ON b.series_id = m.series_id AND b.rn = m.x1",
)
def interpolate_gaps(spark, folder):
    filled = prepare.interpolate_gaps(hourly_grid(spark, folder))
    return filled.select("series_id", "ts", "value", q("filled").alias("filled"))


@query(
    "forward_fill",
    with_ctes("raw", *HOURLY_GRID)
    + "SELECT series_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS filled FROM f",
)
def forward_fill(spark, folder):
    return prepare.forward_fill(hourly_grid(spark, folder)).select("series_id", "ts", "filled")


@query(
    "missing_gate",
    with_ctes("raw", *HOURLY_GRID, (
        "s", "SELECT series_id, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, "
             "avg(CAST(value IS NULL AS INT)) AS missing_rate, avg(CAST(coalesce(value, 0) = 0 AS INT)) AS zero_rate, "
             "min(value) = max(value) AS constant FROM f GROUP BY 1"))
    + f"SELECT series_id, n, missing, {q_sql('missing_rate')} AS missing_rate, {q_sql('zero_rate')} AS zero_rate, "
    "CASE WHEN missing_rate > 0.02 THEN 'missing' WHEN zero_rate > 0.3 THEN 'zeros' WHEN constant THEN 'constant' ELSE 'ok' END AS gate FROM s",
)
def missing_gate(spark, folder):
    gates = prepare.missing_gate(hourly_grid(spark, folder), missing=0.02)
    return gates.select("series_id", "n", "missing", q("missing_rate").alias("missing_rate"),
                        q("zero_rate").alias("zero_rate"), "gate")


@query(
    "constant_guard",
    "SELECT CAST(o_custkey AS VARCHAR) AS series_id, min(o_totalprice) = max(o_totalprice) AS constant FROM orders GROUP BY 1",
)
def constant_guard(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    points = points_from_table(orders, F.col("o_custkey").cast("string"), "o_orderdate", "o_totalprice")
    return prepare.missing_gate(points).select("series_id", "constant")


# -- buckets ---------------------------------------------------------------------------------

def key_sql(trend: str, slot: int, ts: str = "ts") -> str:
    spd, in_day = 86_400 // slot, f"(({ts} % 86400) // {slot})"
    return {
        "daily": in_day,
        "weekly": f"((({ts} // 86400 + 3) % 7) * {spd} + {in_day})",
        "monthly": f"((day(make_timestamp({ts} * 1000000)) - 1) * {spd} + {in_day})",
        "none": "0",
    }[trend]


_KEYED = [(t, s) for t in season.TRENDS for s in (300, 3_600)]


@query(
    "season_keys",
    with_ctes("raw") + "SELECT series_id, event_id, " + ", ".join(
        f"CAST({key_sql(t, s)} AS INT) AS {t}_{s}, "
        f"CAST(({key_sql(t, s)} + {n} - 1) % {n} AS INT) AS prev_{t}_{s}, CAST(({key_sql(t, s)} + 1) % {n} AS INT) AS next_{t}_{s}"
        for t, s in _KEYED for n in [{"daily": 1, "weekly": 7, "monthly": 31}.get(t, 0) * 86_400 // s or 1]
    ) + " FROM raw",
)
def season_keys(spark, folder):
    """Bucket numbers with their wrapped neighbours for every trend."""
    raw = read_events(spark, folder)
    out = ["series_id", "event_id"]
    for t, s in _KEYED:
        key, count = season.season_key(F.col("ts"), t, s), season.bucket_count(t, s)
        out += [
            key.alias(f"{t}_{s}"),
            season.previous_bucket(key, count).alias(f"prev_{t}_{s}"),
            season.next_bucket(key, count).alias(f"next_{t}_{s}"),
        ]
    return raw.select(*out)


_SNAP = "CASE WHEN {x} <= 60 THEN 60 WHEN {x} <= 300 THEN 300 WHEN {x} <= 600 THEN 600 WHEN {x} <= 900 THEN 900 WHEN {x} <= 1800 THEN 1800 ELSE 3600 END"


@query(
    "slot_ladder",
    "WITH p AS (SELECT p_partkey, CAST(p_size * 71 AS INT) AS step FROM part), "
    f"s AS (SELECT p_partkey, step, {_SNAP.format(x='step')} AS slot FROM p) "
    "SELECT p_partkey, step, slot, CASE slot WHEN 60 THEN 300 WHEN 300 THEN 600 WHEN 600 THEN 900 WHEN 900 THEN 1800 WHEN 1800 THEN 3600 END AS coarser, "
    "CASE p_partkey % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'daily' ELSE 'none' END AS coarser_trend FROM s",
)
def slot_ladder(spark, folder):
    """Snap widths to allowed slots, and take the next coarser slot and trend."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    step = (F.col("p_size") * 71).cast("int")
    slot = season.normalize_slot(step)
    trend = F.element_at(F.array(*[F.lit(t) for t in season.TRENDS]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select("p_partkey", step.alias("step"), slot.alias("slot"), season.coarser_slot(slot).alias("coarser"),
                       season.coarser_trend(trend).alias("coarser_trend"))


def _blend_sql(slot: int, t: int, which: str) -> str:
    s = f"CAST(ts % {slot} AS DOUBLE)"
    if which == "prev":
        return f"CASE WHEN {s} < {t} THEN 0.5 - 0.5 * {s} / {t}.0 ELSE 0.0 END"
    return f"CASE WHEN {s} >= {t} AND {s} > {slot - t} THEN 0.5 * (({s} - {slot - t}) / {t}.0) ELSE 0.0 END"


@query(
    "blend_weights",
    with_ctes("raw") + f"SELECT series_id, event_id, {q_sql(_blend_sql(3600, 900, 'prev'))} AS prev_hour, "
    f"{q_sql(_blend_sql(3600, 900, 'next'))} AS next_hour, {q_sql(_blend_sql(300, 150, 'prev'))} AS prev_slot, "
    f"{q_sql(_blend_sql(300, 150, 'next'))} AS next_slot FROM raw",
)
def blend_weights(spark, folder):
    """Weights at hour buckets, and at five-minute slots where half a slot caps the transition."""
    hour = season.blend_weights(F.col("ts"), 3_600, 900)
    slot = season.blend_weights(F.col("ts"), 300, 900)
    return read_events(spark, folder).select(
        "series_id", "event_id", q(hour[0]).alias("prev_hour"), q(hour[1]).alias("next_hour"),
        q(slot[0]).alias("prev_slot"), q(slot[1]).alias("next_slot"),
    )


@query(
    "interval_end_minute",
    with_ctes("raw") + "SELECT event_id, " + ", ".join(
        f"CAST(CASE WHEN (ts % 3600) // 60 = 0 THEN least({i}, 60) ELSE least(CAST(ceil(((ts % 3600) // 60) / {i}.0) AS INT) * {i}, 60) END AS INT) AS every_{i}"
        for i in (7, 15, 60)) + " FROM raw",
)
def interval_end_minute(spark, folder):
    return read_events(spark, folder).select(
        "event_id", *[season.interval_end_minute(F.col("ts"), i).alias(f"every_{i}") for i in (7, 15, 60)]
    )


def calendar_sql(ts: str = "ts") -> dict[str, str]:
    t, tau = f"make_timestamp({ts} * 1000000)", "2.0::DOUBLE * pi()"
    h, w = f"CAST(hour({t}) AS DOUBLE)", f"CAST((({ts} // 86400 + 3) % 7) AS DOUBLE)"
    d, m = f"CAST(day({t}) - 1 AS DOUBLE)", f"CAST(month({t}) - 1 AS DOUBLE)"
    values = [
        f"{h} / 23.0", f"{w} / 6.0", f"{d} / 30.0", f"{m} / 11.0", f"CAST(quarter({t}) - 1 AS DOUBLE) / 3.0",
        f"CASE WHEN {w} >= 5 THEN 1.0 ELSE 0.0 END",
        f"sin({h} * ({tau} / 24))", f"cos({h} * ({tau} / 24))", f"sin({w} * ({tau} / 7))", f"cos({w} * ({tau} / 7))",
        f"sin({m} * ({tau} / 12))", f"cos({m} * ({tau} / 12))", f"sin({d} * ({tau} / 31))", f"cos({d} * ({tau} / 31))",
    ]
    return dict(zip(FEATURES, values))


@query(
    "calendar_features",
    with_ctes("daily", "raw", ("u", "SELECT series_id, ts FROM daily UNION SELECT series_id, ts FROM raw"))
    + "SELECT series_id, ts, " + ", ".join(f"{q_sql(x)} AS {n}" for n, x in calendar_sql().items()) + " FROM u",
)
def calendar_features_query(spark, folder):
    points = read_daily_orders(spark, folder).select("series_id", "ts").union(
        read_events(spark, folder).select("series_id", "ts")).distinct()
    features = points.select("series_id", "ts", *calendar_features(F.col("ts")))
    return features.select("series_id", "ts", *[q(n).alias(n) for n in FEATURES])


@query(
    "infer_slot",
    with_ctes(
        "pts",
        ("g", "SELECT series_id, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM pts"),
        ("r", "SELECT series_id, gap, row_number() OVER (PARTITION BY series_id ORDER BY gap) AS r, "
              "count(*) OVER (PARTITION BY series_id) AS n FROM g WHERE gap > 0"),
    )
    + f"SELECT series_id, CAST({_SNAP.format(x='gap')} AS INT) AS slot FROM r WHERE r = n // 2 + 1",
)
def infer_slot(spark, folder):
    from metricwatch.plans.profile import infer_slots

    return infer_slots(pts(spark, folder))


@query(
    "confidence_multiplier",
    "SELECT c_custkey, " + q_sql(lookup_interpolate_sql("(45.0 + (c_custkey % 600) / 10.0::DOUBLE)", CONFIDENCE_TABLE))
    + " AS z FROM customer",
)
def confidence(spark, folder):
    level = F.lit(45.0) + (F.col("c_custkey") % 600) / F.lit(10.0)
    return spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", q(confidence_multiplier(level)).alias("z"))
