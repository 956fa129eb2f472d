"""Values at a high level and missing values must not change what a detector says."""

import math
import random

from metricwatch.operators.changepoint import change_points
from metricwatch.operators.hypothesis import kpss
from metricwatch.operators.ordered import row_index
from metricwatch.operators.outliers import gated, robust_flags
from metricwatch.plans.classify import classify
from metricwatch.plans.dynamics import bucket_moments

HIGH = 1e9


def test_spread_at_a_high_level(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(500)]
    mean = sum(values) / 500
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / 500)
    rows = [(s, 0, level + v) for s, level in (("low", 0.0), ("high", HIGH)) for v in values]
    got = {r.series_id: r.std for r in bucket_moments(spark.createDataFrame(rows, "series_id string, bucket int, value double")).collect()}
    assert abs(got["low"] - std) < 1e-9 and abs(got["high"] - std) < 1e-5


def test_change_points_at_a_high_level(points):
    rng = random.Random(2)
    shape = [rng.gauss(0, 1) + (0 if i < 120 else 8 if i < 200 else 2) for i in range(300)]
    rows = [("low", i * 60, v) for i, v in enumerate(shape)] + [("high", i * 60, v + HIGH) for i, v in enumerate(shape)]
    found = change_points(row_index(points(rows))).collect()
    splits = {s: sorted(r.rn for r in found if r.series_id == s) for s in ("low", "high")}
    assert splits["low"] == splits["high"]
    assert {120, 200} <= set(splits["high"]) and len(splits["high"]) <= 4


def test_one_gap_leaves_the_class_as_it_is(points):
    rng = random.Random(3)
    wave = [math.sin(2 * math.pi * i / 24) * 10 + 50 + rng.gauss(0, 0.5) for i in range(800)]
    rows = [("whole", i * 3600, v) for i, v in enumerate(wave)] + [("gap", i * 3600, None if i == 333 else v) for i, v in enumerate(wave)]
    got = {r.series_id: r for r in classify(points(rows)).collect()}
    assert got["gap"].kind == got["whole"].kind
    assert got["gap"].periods == got["whole"].periods and 24 in got["gap"].periods
    p = {r.series_id: r.kpss for r in kpss(row_index(points(rows))).collect()}
    assert abs(p["gap"] - p["whole"]) < 0.05


def test_missing_values_close_the_gate_as_zeros_do(points):
    value = lambda i: 90.0 if i == 50 else 5.0 + i % 3
    rows = [("gaps", i, None if i % 5 < 2 and i != 50 else value(i)) for i in range(100)] + [("whole", i, value(i)) for i in range(100)]
    table = points(rows)
    got = {(r.series_id, r.ts): r.anomaly for r in gated(table, robust_flags(table)).collect()}
    assert got["whole", 50] == 1
    assert sum(v for (s, _), v in got.items() if s == "gaps") == 0
