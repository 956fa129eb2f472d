"""Blocks and halos must give what one window over the whole series gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricwatch.operators import correlation, hypothesis, prepare
from metricwatch.operators.ordered import known_neighbours, rolling, row_index, running_sum
from metricwatch.operators.quantiles import exact_quantiles, median_mad


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    hot = [("hot", 1_000_000 + 40_000 * i + int(rng.integers(0, 30_000)), float(v)) for i, v in enumerate(rng.normal(size=400).round(2))]
    return hot + [("cold", 5_000 + 60 * i, float(i % 5)) for i in range(23)] + [("one", 7, 3.0)]


def by_series(df, *columns):
    out = {}
    for r in df.orderBy("series_id", "ts").collect():
        out.setdefault(r["series_id"], []).append(tuple(r[c] for c in columns))
    return out


def values(walk, series):
    return np.array([v for s, _, v in sorted(walk) if s == series])


def test_row_index_counts_across_chunks(points, walk):
    found = by_series(row_index(points(walk), total="n"), "rn", "n")
    for series, rows in found.items():
        n = len(values(walk, series))
        assert rows == [(i, n) for i in range(n)]


def test_rolling_in_small_blocks(points, walk):
    indexed = row_index(points(walk))
    found = rolling(indexed, {
        "mean": lambda w: F.avg("value").over(w.rowsBetween(-4, 3)),
        "lag": lambda w: F.lag("value", 4).over(w),
    }, back=4, ahead=3, block_rows=8)
    for series, rows in by_series(found, "mean", "lag").items():
        v = values(walk, series)
        for i, (mean, lag) in enumerate(rows):
            assert mean == pytest.approx(v[max(0, i - 4): i + 4].mean())
            assert lag == (v[i - 4] if i >= 4 else None)


def test_running_sum_in_small_blocks(points, walk):
    found = running_sum(row_index(points(walk)), {"total": "value"}, block_rows=16)
    for series, rows in by_series(found, "total").items():
        assert [r[0] for r in rows] == pytest.approx(list(values(walk, series).cumsum()))


def test_known_neighbours_across_empty_blocks(points):
    rows = [("s", i, 5.0 if i in (3, 40) else None) for i in range(50)]
    found = by_series(known_neighbours(row_index(points(rows)), block_rows=4), "before", "after")["s"]
    assert found[2][0] is None and found[2][1]["at"] == 3
    assert found[20][0]["at"] == 3 and found[20][1]["at"] == 40
    assert found[45][1] is None


def test_interpolation_keeps_edges(points):
    filled = prepare.interpolate_gaps(row_index(points([("s", i, v) for i, v in enumerate([None, 1, None, None, 4, None])])))
    assert [r[0] for r in by_series(filled, "filled")["s"]] == [None, 1.0, 2.0, 3.0, 4.0, None]


@pytest.mark.parametrize("kind", ["linear", "lower", "higher", "nearest", "midpoint"])
def test_exact_quantiles_with_ties(points, walk, kind):
    rows = walk + [("ties", i, 1.0 if i < 300 else float(i)) for i in range(350)]
    found = exact_quantiles(points(rows), ["series_id"], "value", {"a": 0.25, "b": 0.5, "c": 0.99}, kind).collect()
    assert len(found) == 4
    for r in found:
        v = np.sort([x for s, _, x in rows if s == r["series_id"]])
        for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.99)):
            h = (len(v) - 1) * p
            lo, hi, f = v[int(h)], v[min(int(h) + 1, len(v) - 1)], h - int(h)
            want = {"linear": lo + f * (hi - lo), "lower": lo, "higher": hi, "nearest": lo if f < 0.5 else hi, "midpoint": (lo + hi) / 2}[kind]
            assert r[name] == pytest.approx(want), (r["series_id"], name)


def test_median_mad_floor(points):
    r = median_mad(points([("flat", i, 200.0) for i in range(9)]), ["series_id"]).first()
    assert (r["median"], r["scale"]) == (200.0, 1.0)


def test_lag_products_in_small_blocks(points, walk):
    rows = row_index(points(walk))
    found = {(r["series_id"], r["lag"]): (r["product"], r["pairs"]) for r in correlation.lag_products(rows, [0, 3, 7], block_rows=8).collect()}
    for series in ("hot", "cold", "one"):
        v = values(walk, series)
        for lag in (0, 3, 7):
            product, pairs = found[(series, lag)]
            assert product == pytest.approx(float(v[lag:] @ v[: len(v) - lag]) if lag < len(v) else 0.0)
            assert pairs == max(len(v) - lag, 0)


def sign_sum(v):
    return int(np.sign(v[None, :] - v[:, None])[np.triu_indices(len(v), 1)].sum())


@pytest.mark.parametrize("batch", [7, 10_000])
def test_sign_sums_over_several_digits_with_ties(spark, points, batch):
    """More than 65,536 different ranks would be slow to check: ranks are given, up to three digits wide."""
    rng = np.random.default_rng(5)
    series = {"wide": rng.integers(0, 1 << 20, 1_500), "ties": rng.integers(0, 3, 900), "low": rng.integers(0, 300, 900) // 2,
              "rising": np.arange(600), "falling": np.arange(600)[::-1] * 70_000, "equal": np.zeros(50, int), "one": np.array([4])}
    rows = spark.createDataFrame([(s, i, int(v)) for s, vs in series.items() for i, v in enumerate(vs)], "series_id string, rn long, rank long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = {r["series_id"]: (r["n"], r["s"]) for r in hypothesis.sign_sums(rows, block_rows=64).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {s: (len(v), sign_sum(v)) for s, v in series.items()}


def test_mann_kendall_against_all_pairs(points, walk):
    found = {r["series_id"]: r["s"] for r in hypothesis.mann_kendall(row_index(points(walk)), block_rows=16).collect()}
    for series in ("hot", "cold", "one"):
        v = values(walk, series)
        assert found[series] == int(np.sign(v[None, :] - v[:, None])[np.triu_indices(len(v), 1)].sum())


def test_circular_autocorrelation(points, walk):
    found = correlation.circular_autocorrelation(row_index(points(walk)), "value", 12)
    for r in found.where("series_id = 'cold'").collect():
        v = values(walk, "cold")
        assert r["ac"] == pytest.approx(float((v * np.roll(v, -r["lag"])).mean()))


def test_resampling_grid_and_splits(points):
    p = points([("s", 0, 1), ("s", 30, 3), ("s", 200, 5), ("t", 10, 2)])
    hourly = prepare.resample(p, 60)
    assert sorted(tuple(r) for r in hourly.collect()) == [("s", 0, 2.0), ("s", 180, 5.0), ("t", 0, 2.0)]
    grid = by_series(prepare.regular_grid(hourly, 60), "ts", "value")
    assert grid["s"] == [(0, 2.0), (60, None), (120, None), (180, 5.0)]
    roles = by_series(prepare.cold_start_split(points([("s", i, i) for i in range(30)] + [("t", i, i) for i in range(9)])), "role")
    assert [sum(r == ("history",) for r in roles[s]) for s in "st"] == [21, 4]
    assert prepare.step_for(60, 7 * 86_400, 1_500) == 403 and prepare.step_for(60, 7 * 86_400, fixed_step=300) == 300


def test_quantiles_without_broadcast(points, walk, monkeypatch):
    """More keys than may be broadcast: both sides are spread instead, with the same result."""
    from functools import partial

    from metricwatch.operators import joins, quantiles

    monkeypatch.setattr(quantiles, "attach_checked", partial(joins.attach_checked, most=0))
    for r in exact_quantiles(points(walk), ["series_id"], "value", {"m": 0.5}).collect():
        assert r["m"] == pytest.approx(float(np.median(values(walk, r["series_id"]))))


def test_peak_intervals_of_any_two(spark):
    found = spark.createDataFrame([("s", lag) for lag in (3, 7, 11, 12)], "series_id string, lag long")
    got = {r["interval"]: r["frequency"] for r in correlation.peak_intervals(found, True).collect()}
    assert got == {4: 2, 8: 1, 5: 1, 9: 1, 1: 1}
