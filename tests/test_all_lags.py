import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricwatch.operators import correlation, decompose
from metricwatch.operators.ordered import row_index


def rows_of(points, named, step=60):
    return row_index(points([(s, step * i, v) for s, values in named.items() for i, v in enumerate(values)]), total="n")


def plain(x):
    n = len(x)
    return [sum(x[i] * x[(i + lag) % n] for i in range(n)) / n for lag in range(n)]


@pytest.mark.parametrize("block_rows", [4, 7, 64, 1 << 16])
def test_all_circular_lags_equal_plain_loops(points, block_rows):
    rng = random.Random(block_rows)
    named = {f"s{n}": [rng.gauss(5, 3) for _ in range(n)] for n in (1, 2, 3, 29, 64, 130)}
    got = {}
    for r in correlation.circular_autocorrelation(rows_of(points, named), "value", block_rows=block_rows).collect():
        got.setdefault(r.series_id, {})[r.lag] = (r.ac, r.n)
    for name, x in named.items():
        assert sorted(got[name]) == list(range(len(x)))
        assert all(got[name][lag][1] == len(x) for lag in got[name])
        np.testing.assert_allclose([got[name][lag][0] for lag in range(len(x))], plain(x), rtol=1e-9, atol=1e-9)


def test_fewer_lags_and_missing_values(points):
    x = [1.0, None, 3.0, -2.0, None, 4.0, 0.5]
    rows = rows_of(points, {"a": x})
    got = {r.lag: r.ac for r in correlation.circular_autocorrelation(rows, "value", 3, block_rows=2).collect()}
    want = plain([v or 0.0 for v in x])
    assert sorted(got) == [0, 1, 2, 3]
    np.testing.assert_allclose([got[k] for k in range(4)], want[:4], atol=1e-12)
    assert correlation.circular_autocorrelation(rows.limit(0), "value").count() == 0


def test_plain_autocorrelation_reads_every_lag(points):
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(5000) / 90) + rng.normal(0, 0.1, 5000)
    rows = rows_of(points, {"a": x.tolist()})
    got = correlation.autocorrelation(rows, max_lag=4999, block_rows=512).orderBy("lag").collect()
    c = x - x.mean()
    want = np.correlate(c, c, "full")[4999:] / (c @ c)
    assert [r.lag for r in got] == list(range(5000))
    np.testing.assert_allclose([r.acf for r in got], want, atol=1e-9)


def test_a_long_period_is_found(points):
    """A period of 300 among steps of a random level, longer than any lag list kept before."""
    rng = np.random.default_rng(5)
    shape = rng.normal(0, 3, 300)
    x = np.tile(shape, 9) + rng.normal(0, 0.2, 2700)
    rows = rows_of(points, {"long": x.tolist(), "daily": np.tile(shape[:24], 100).tolist()})
    got = {r.series_id: r.period for r in decompose.dominant_period(rows, "value", 300).collect()}
    assert got == {"long": 300, "daily": 24}


def test_a_long_period_is_taken_off(points):
    rng = np.random.default_rng(6)
    shape = rng.normal(0, 3, 300)
    x = np.tile(shape, 12) + rng.normal(0, 0.05, 3600)
    rows = rows_of(points, {"long": x.tolist()})
    got = decompose.auto_decompose(rows, rounds=1, max_period=300).orderBy("rn").collect()
    assert got[0].periods == [300]
    left = np.array([r.y for r in got[300:-300]])
    assert left.std() < 0.2


def test_centred_mean_of_wide_periods(points):
    x = [float((i * i) % 17) for i in range(900)]
    rows = rows_of(points, {"a": x, "b": x[:50]}).withColumn("h", F.when(F.col("series_id") == "a", 200).otherwise(3))
    got = {(r.series_id, r.rn): r.m for r in decompose.centred_mean(rows, "value", "m", F.col("h")).collect()}
    for name, half in (("a", 200), ("b", 3)):
        v = x if name == "a" else x[:50]
        for i in range(len(v)):
            seen = v[max(0, i - half): i + half + 1]
            assert got[name, i] == pytest.approx(sum(seen) / len(seen))
