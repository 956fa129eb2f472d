import numpy as np
from pyspark.sql import functions as F

from metricwatch.operators import joins, quantiles

PROBS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q99": 0.99, "top": 1.0}


def check(got, want):
    for name, p in PROBS.items():
        assert np.isclose(got[name], np.quantile(want, p), rtol=1e-12, atol=0)
    assert got["n"] == len(want)


def test_cut_again_equals_sorted_at_once(spark):
    """Ties, one value only, missing values, few rows and none; stretches longer than four values are cut again."""
    rng = np.random.default_rng(3)
    series = {
        "even": rng.normal(size=9_000), "ties": rng.integers(0, 40, 5_000).astype(float), "one": np.full(3_000, 7.5),
        "few": np.array([3.0, -1.0]), "far": np.r_[rng.normal(size=4_000), rng.normal(size=3_000) * 1e9],
    }
    rows = [(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)]
    rows += [("few", 10, None), ("none", 0, None)]
    points = spark.createDataFrame(rows, "series_id string, ts long, value double")
    got = {r["series_id"]: r for r in quantiles.exact_quantiles(points, ["series_id"], "value", PROBS, most=4).collect()}
    assert set(got) == set(series)
    for s, x in series.items():
        check(got[s], x)
    assert quantiles.exact_quantiles(points.limit(0), ["series_id"], "value", PROBS, most=4).count() == 0


def test_no_stretch_is_longer_than_the_bound(spark):
    """Two million values of one series, different all."""
    n, most = 2_000_000, 1_000
    value = (F.col("id") * 7919 % 1999993).cast("double") + F.col("id") / 1e7
    points = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("ts"), value.alias("value"))
    i = np.arange(n)
    check(quantiles.exact_quantiles(points, ["series_id"], "value", PROBS, most=most).first(), (i * 7919 % 1999993).astype(float) + i / 1e7)
    counts = points.select("series_id", F.lit(0).cast("long").alias("_base"), F.lit(n).cast("long").alias("n"), F.col("value").alias("_v"), F.lit(1).cast("long").alias("_c"))
    rank = F.col("n") / 2
    left = quantiles._narrowed(counts, ["series_id"], lambda a, b: (rank >= a) & (rank < b), most)
    assert 0 < left.groupBy("_base").count().agg(F.max("count")).first()[0] <= most
    assert left.select("_base").distinct().count() == 1


def test_a_side_of_many_bytes_is_not_broadcast(spark, monkeypatch):
    points = spark.range(50).select((F.col("id") % 5).cast("string").alias("series_id"), F.col("id").alias("ts"))
    per_key = spark.range(5).select(F.col("id").cast("string").alias("series_id"), F.array_repeat(F.col("id"), 40).alias("cuts"))
    assert joins.value_bytes(per_key) is not None
    assert per_key.agg(joins.value_bytes(per_key)).first()[0] == 5 * (1 + 8 + 40 * 8 + 8)
    assert per_key.limit(0).agg(joins.value_bytes(per_key)).first()[0] == 0
    want = sorted(tuple(map(str, r)) for r in joins.attach_checked(points, per_key).collect())
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100)
    spread = joins.attach_checked(points, per_key)
    assert joins.SALT not in spread.columns
    assert sorted(tuple(map(str, r)) for r in spread.collect()) == want
