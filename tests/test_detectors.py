"""Hand-made series with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricwatch import api
from metricwatch.functions import season
from metricwatch.operators import changepoint, evaluate, forest, outliers
from metricwatch.operators.ordered import row_index
from metricwatch.operators.robust_buckets import center_scale, keep_ranges, scrub
from metricwatch.options import DynamicsOptions, FunnelOptions, OutlierOptions
from metricwatch.plans import classify, dynamics, forecast, funnel, profile

MONDAY = 1_699_833_600  # 2023-11-13 00:00 UTC
DAY, HOUR = 86_400, 3_600


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("series_id", "ts").collect()]


def test_season_keys_and_slots(spark):
    times = spark.createDataFrame([(MONDAY,), (MONDAY + DAY + 5 * HOUR,), (-1,)], "ts long")
    got = [r[0] for r in times.select(season.season_key(F.col("ts"), "weekly").alias("k")).collect()]
    assert got == [0, 29, 2 * 24 + 23]  # the last second of 1969 was a Wednesday
    one = spark.range(1)
    assert one.select(season.snap_slot(15), season.normalize_slot(0), season.normalize_slot(400), season.snap_slot(9_999)).first()[:] == (60, 3600, 600, 3600)


def hour_levels(value):
    return [("s", MONDAY + d * DAY + h * HOUR + m * 300, value(h)) for d in range(10) for h in range(24) for m in range(12)]


def test_blend_at_hour_edges(points):
    history = points(hour_levels(lambda h: 200.0 if h == 11 else 100.0))
    at = [MONDAY + 10 * DAY + 11 * HOUR + s for s in (0, 1_800)]
    now = points([("s", t, 150.0) for t in at])
    smooth = rows_of(dynamics.detect_dynamics(now, history, DynamicsOptions("daily")), "baseline")
    stairs = rows_of(dynamics.detect_dynamics(now, history, DynamicsOptions("daily", transition_minutes=0)), "baseline")
    assert [b for (b,) in smooth] == pytest.approx([150.0, 200.0])
    assert [b for (b,) in stairs] == pytest.approx([200.0, 200.0])


def test_cold_start_and_missing_buckets(points):
    now = points([("s", MONDAY + 10 * DAY, 5.0), ("new", MONDAY + 10 * DAY, 5.0)])
    found = rows_of(dynamics.detect_dynamics(now, points(hour_levels(lambda h: 1.0))), "series_id", "baseline", "anomaly")
    assert found == [("new", None, 0), ("s", 1.0, 1)]


def test_lower_bound_stops_at_zero(points):
    history = points([("s", MONDAY + d * DAY, v) for d, v in enumerate([0, 10, 0, 10])])
    found = rows_of(dynamics.detect_dynamics(points([("s", MONDAY + 5 * DAY, -1)]), history, DynamicsOptions("daily")), "lower_bound", "anomaly")
    assert found == [(0.0, 1)]


def test_scrub_reaches_a_fixpoint_and_keeps_enough():
    v, c = scrub(np.array([1.0, 2.0, 3.0, 50.0]), np.array([3, 4, 3, 1]), 3.5, 5)
    assert v.tolist() == [1.0, 2.0, 3.0]
    v, _ = scrub(np.array([1.0, 50.0]), np.array([4, 1]), 3.5, 5)
    assert v.tolist() == [1.0, 50.0]
    assert center_scale(np.array([1.0]), np.array([5])) == (1.0, 0.005)


def test_history_spike_raises_no_alert(points):
    history = points([("s", MONDAY + d * DAY + m * 60, 500.0 if (d, m) == (4, 3) else 100.0 + m % 3) for d in range(10) for m in range(60)])
    now = points([("s", MONDAY + 10 * DAY + m * 60, 101.0) for m in range(5)] + [("s", MONDAY + 10 * DAY + 600, 400.0)])
    options = FunnelOptions(trend="daily", bucket_slot_secs=3_600)
    found = rows_of(funnel.detect_funnel(now, history, options), "anomaly")
    assert found == [(0,)] * 5 + [(1,)]


def test_ingest_is_idempotent_and_evicts(points):
    first = points([("s", MONDAY + 60 * i, i) for i in range(240)])
    later = points([("s", MONDAY + 600 + 60 * i, i) for i in range(240)])
    once = profile.upsert(first, later)
    assert once.count() == 250 and profile.upsert(once, later).count() == 250
    newest = once.groupBy("series_id").agg(F.max("ts").alias("last_seen_ts"))
    assert profile.evict(once, newest, 600).count() == 11


def test_profile_falls_back_to_coarser_buckets(points):
    few = points([("s", MONDAY + d * DAY + h * HOUR, h) for d in range(6) for h in range(24)])
    options = FunnelOptions(trend="weekly")
    meta = profile.choose_buckets(few, profile.wanted_buckets(few, options), options).first()
    assert (meta["trend"], meta["effective_trend"], meta["slot_secs"]) == ("weekly", "daily", 3600)


def test_keep_ranges_from_counts(points):
    samples = points([("s", i, 100.0) for i in range(20)] + [("s", 99, 500.0)]).withColumn("bucket", F.lit(0))
    r = keep_ranges(samples, 3.5, 5).first()
    assert (r["keep_from"], r["keep_to"]) == (100.0, 100.0)


def test_robust_routes(points):
    rng = np.random.default_rng(1)
    flat = [("flat", i, 1.0) for i in range(50)]
    mad = [("mad", i, v) for i, v in enumerate([10.0] * 50 + [100.0] + [10.0] * 49)]
    heavy = [("heavy", i, v) for i, v in enumerate(rng.exponential(1.0, 300).tolist() + [60.0])]
    p = points(flat + mad + heavy)
    found = outliers.gated(p, outliers.robust_flags(p))
    hit = {r["series_id"]: r["n"] for r in found.groupBy("series_id").agg(F.sum("anomaly").alias("n")).collect()}
    assert hit["flat"] == 0 and hit["heavy"] >= 1
    assert found.where("series_id = 'heavy' and value = 60").first()["anomaly"] == 1
    fences = outliers.robust_fences(p.where("series_id = 'mad'"))
    flags = p.where("series_id = 'mad'").join(fences, "series_id").withColumn("f", outliers.flag_columns()["mad"])
    assert [r["ts"] for r in flags.where("f = 1").collect()] == [50]


def test_change_point_is_found(points):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 120), rng.normal(8, 1, 80), rng.normal(0, 1, 60)])
    found = changepoint.change_points(row_index(points([("s", 60 * i, x) for i, x in enumerate(v)])))
    assert sorted(r["rn"] for r in found.collect()) == [120, 200]


def test_forest_is_repeatable_and_finds_a_spike(points):
    rng = np.random.default_rng(5)
    v = rng.normal(10, 1, 400)
    v[250] = 60
    indexed = row_index(points([("s", 60 * i, x) for i, x in enumerate(v)]))
    options = OutlierOptions(n_trees=30, sample_size=64)
    model = tuple(t.persist() for t in forest.fit_forest(indexed, options))
    assert model[1].select("tree").distinct().count() == 30
    fresh = {r["rn"]: r["score"] for r in forest.forest_scores(indexed, options).collect()}
    stored = {r["rn"]: r["score"] for r in forest.forest_scores(indexed.repartition(3), options, model).collect()}
    assert fresh == pytest.approx(stored)
    # The spike also shows in the rows whose lag or mean holds it.
    assert 250 <= max(fresh, key=fresh.get) <= 255 and fresh[250] > np.quantile(list(fresh.values()), 0.97)


def test_large_trees_grow_level_by_level(points, monkeypatch):
    """Nodes above the bound are split by groupings; the trees are whole and rank planted spikes first."""
    rng = np.random.default_rng(6)
    v, w = rng.normal(10, 1, 1_500), rng.normal(0, 1, 30)
    spikes = {200, 700, 1_200}
    for i in spikes:
        v[i] = 90
    indexed = row_index(points([("long", 60 * i, x) for i, x in enumerate(v)] + [("short", 60 * i, x) for i, x in enumerate(w)] + [("equal", 0, 1.0)]))
    options, split, seen = OutlierOptions(n_trees=6, sample_size=500), forest.split_large, []
    monkeypatch.setattr(forest, "split_large", lambda *args: seen.append(split(*args)) or seen[-1])
    raw = forest.forest_features(indexed)
    scaled = forest.standardise(raw, forest.feature_scaling(raw)).persist()
    assert forest.has_large_samples(scaled, options, 150) and not forest.has_large_samples(scaled, options, forest.TASK_ROWS)
    rows = forest.tree_samples(scaled, options)
    tree_nodes = forest.train_forest(scaled, options, task_rows=150).persist()
    left = [r["count"] for part in seen[0][1] for r in part.groupBy(*forest.NODE).count().collect()]
    assert max(left) <= 150

    made = tree_nodes.toPandas()
    sizes = rows.groupBy("series_id", "tree").count().collect()
    for r in sizes:
        tree = made[(made.series_id == r["series_id"]) & (made.tree == r["tree"])].set_index("node")
        assert tree[tree.left < 0]["size"].sum() == r["count"] == tree.loc[0, "size"] == tree["sample"].iloc[0]
        inner = tree[tree.left >= 0]
        assert tree.index.is_unique and len(tree) == 2 * len(inner) + 1
        for side in ("left", "right"):
            assert (tree.loc[inner[side], "depth"].to_numpy() == inner["depth"].to_numpy() + 1).all()
        assert (tree.loc[inner.left, "size"].to_numpy() + tree.loc[inner.right, "size"].to_numpy() == inner["size"].to_numpy()).all()
    scores = {(r["series_id"], r["rn"]): r["score"] for r in forest.score_forest(scaled, tree_nodes).collect()}
    cut = {(r["series_id"], r["rn"]): r["score"] for r in forest.score_forest(scaled, tree_nodes, block_rows=400, task_nodes=100).collect()}
    assert len(scores) == 1_531 and scores == pytest.approx(cut)
    best = sorted((rn for s, rn in scores if s == "long"), key=lambda rn: -scores[("long", rn)])[:15]
    assert all(any(0 <= rn - i <= 5 for i in spikes) for rn in best)


def test_trending_and_short_series(points):
    up = [("up", HOUR * i, 0.1 * i + (i % 3) * 0.01) for i in range(100)]
    found = {r["series_id"]: r for r in classify.classify(points(up + [("tiny", i, i) for i in range(5)])).collect()}
    assert (found["up"]["kind"], found["up"]["heading"]) == ("trending", "up")
    assert (found["tiny"]["kind"], found["tiny"]["gate"]) == (None, "too_short")


def test_persistence_has_mase_one(points):
    now = points([("s", i, i) for i in range(1, 6)]).withColumn("pred", F.col("value") - 1)
    naive = points([("s", 0, 0)]).select("series_id", F.lit(1.0).alias("naive_mae"), F.lit(1.0).alias("naive_rmse"))
    r = evaluate.forecast_quality(now, naive.select("series_id", "naive_mae"), naive).first()
    assert (r["mae"], r["mase"], r["passed"]) == (1.0, 1.0, False)


def test_quality_without_hits_is_zero(points):
    rows = points([("s", i, i) for i in range(3)]).withColumn("anomaly", F.lit(0)).withColumn("label", F.lit(0))
    r = evaluate.detection_quality(rows).first()
    assert (r["precision"], r["recall"], r["f1"], r["clean_passed"]) == (0.0, 0.0, 0.0, True)


def test_latest_alert_only(points):
    rows = points([("s", i, i) for i in range(5)]).withColumn("anomaly", F.element_at(F.array(*[F.lit(x) for x in (0, 1, 0, 1, 1)]), F.col("ts").cast("int") + 1))
    assert [a for (a,) in rows_of(funnel.shape_alerts(rows, "latest_only"), "anomaly")] == [0, 0, 0, 0, 1]


def test_forecast_follows_a_daily_shape(points, tmp_path):
    def value(i):
        return 50 + 20 * np.sin(i * np.pi / 12)

    history = points([("s", MONDAY + HOUR * i, value(i)) for i in range(24 * 14)])
    now = points([("s", MONDAY + HOUR * i, value(i) + (200 if i == 350 else 0)) for i in range(24 * 14, 24 * 15)])
    options = forecast.ForecastOptions(periods=(24,), iterations=5, max_depth=3)
    model, scale = forecast.train_forecast(history, options)
    forecast.save_model(model, scale, str(tmp_path))
    found = forecast.score_forecast(now, *forecast.load_model(history.sparkSession, str(tmp_path)), options)
    flags = {r["ts"]: r["anomaly"] for r in found.collect()}
    assert len(flags) == 24 and flags[MONDAY + HOUR * 350] == 1


def test_forecast_learns_opposite_shapes_keeps_gaps_and_stops_early(points):
    """Two series of opposite daily shape, one with unknown values: every point is predicted, better than by repetition."""
    rng = np.random.default_rng(3)

    def value(series, i):
        if series == "up" and i % 13 == 0:
            return None
        return (1 if series == "up" else -1) * 20 * np.sin(i * np.pi / 12) + rng.normal(0, 1)

    rows = [(s, MONDAY + HOUR * i, value(s, i)) for s in ("up", "down") for i in range(24 * 15)]
    start = MONDAY + HOUR * 24 * 14
    history, now = points([r for r in rows if r[1] < start]), points([r for r in rows if r[1] >= start])
    options = forecast.ForecastOptions(iterations=12, max_depth=3, step_size=0.5)
    model = forecast.train_forecast(history, options)
    assert model[0].getNumTrees < 12  # what is left is noise
    found = forecast.detect_forecast(now, None, options, model).collect()
    assert len(found) == 48 and all(r["baseline"] is not None for r in found)
    known = {(s, t): v for s, t, v in rows if v is not None}
    for series in ("up", "down"):
        error = np.mean([abs(r["value"] - r["baseline"]) for r in found if r["series_id"] == series and r["value"] is not None])
        steps = [abs(v - known[(s, t - HOUR)]) for (s, t), v in known.items() if s == series and t < start and (s, t - HOUR) in known]
        assert error / np.mean(steps) < 1
    assert sum(r["value"] is None for r in found) == sum(v is None for s, t, v in rows if t >= start)


def test_api_checks_its_input(points):
    with pytest.raises(ValueError):
        api.detect("nope", points([]))
    with pytest.raises(ValueError):
        api.detect("funnel", points([]))
    with pytest.raises(ValueError):
        FunnelOptions(k_inner=3.0)
    found = api.detect("outlier", points([("s", i, 1.0) for i in range(5)]))
    assert found.columns == ["series_id", "ts", "value", "anomaly"] and found.count() == 5
