import numpy as np
from pyspark.sql import functions as F

from metricwatch.operators import forest
from metricwatch.options import OutlierOptions


def test_a_tenth_of_a_million_rows_is_one_task(spark):
    rows = spark.range(970_000).select(F.lit("s").alias("series_id"))
    assert not forest.has_large_samples(rows, OutlierOptions(), forest.TASK_ROWS)


def test_levels_are_kept_in_files(spark):
    """What is left to the driver is one scan of the nodes and one of the rows, however many levels there were."""
    names = [F.rand(i).alias(f) for i, f in enumerate(forest.FOREST_FEATURES)]
    rows = spark.range(400).select(
        F.lit("s").alias("series_id"), F.lit(0).alias("tree"), F.col("id").alias("ts"), *names,
        F.lit(0).cast("long").alias("root"), F.lit(400).cast("long").alias("sample"), F.lit(9).cast("long").alias("limit"))
    nodes, rest = forest.split_large(rows, 42, 3, 60)
    assert [len(nodes), len(rest)] == [1, 1]
    for table in (*nodes, *rest):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Union" not in plan and plan.count("Relation") == 1
    assert nodes[0].agg(F.max("depth")).first()[0] >= 2
    assert rest[0].count() + (nodes[0].where("left < 0").agg(F.sum("size")).first()[0] or 0) == 400


def test_tree_arrays():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5_000, 4))
    x[:50] = 3.0  # equal rows stay together
    for level in (0, 3):
        tree = forest.grow_tree(x, np.random.default_rng(2), level, 30)
        inner = tree["left"] >= 0
        at = dict(zip(tree["node"], range(len(inner))))
        left, right = ([at[i] for i in tree[c][inner]] for c in ("left", "right"))
        assert len(at) == len(inner) == 2 * inner.sum() + 1 and tree["size"][0] == tree["size"][~inner].sum() == 5_000
        assert (tree["size"][left] + tree["size"][right] == tree["size"][inner]).all() and tree["size"][~inner].max() >= 50
        assert ((tree["normal"][inner] != 0).sum(axis=1) == level + 1).all()
        # the rows of the sample come back to the leaves that they made
        leaves = {**tree, "sample": np.full(len(inner), 5_000)}
        ends = tree["depth"] + forest.average_path(tree["size"])
        share = np.average(ends[~inner], weights=tree["size"][~inner]) / forest.average_path(5_000)
        assert np.isclose(forest.path_lengths(x, leaves).mean(), share)
    assert len(forest.grow_tree(x[:1], rng, 3, 5)["node"]) == len(forest.grow_tree(x, rng, 3, 0)["node"]) == 1
