"""Extended isolation forest: one forest per series, grown and applied in parallel.

A tree is grown from its own sample of a series. Nodes of more than TASK_ROWS rows are split a
level at a time, all trees of all series together: a grouping gives each node its box, the node
draws a cut, a join sends its rows to one side. What a level settles is added to files, so no plan
grows with the levels. Smaller nodes are finished by one task each, as arrays. A score needs a block
of rows and some of the trees of their series. Features and nodes are written once and read by every
step. Every random choice comes from a hash or a seeded generator, so a lost task gives the same
result when it runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.operators.features import (
    FOREST_FEATURES, feature_scaling, forest_features, standardise,
)
from metricwatch.operators.joins import attach, attach_checked
from metricwatch.operators.ordered import BLOCK_ROWS
from metricwatch.options import OutlierOptions
from metricwatch.session import cut_lineage, delete_written, table_path, written

SAMPLE_SHARE = 0.1
TASK_ROWS = 1 << 19  # rows of a node that one task finishes: 32 bytes each as an array
SCORE_ROWS = 1 << 19  # rows that a scoring task holds; the trees are sent once for each such block
TASK_NODES = 1 << 19  # nodes of the trees that a scoring task holds, up to its last tree
PATH_UNIT = float(1 << 32)  # path lengths add up as whole numbers of this fraction
LOCAL_BITS = 20  # a task's subtree has fewer than 2 * TASK_ROWS nodes
EULER = 0.5772156649015329
NODE_SCHEMA = (
    "series_id string, tree int, node long, left long, right long, size long, depth int, "
    "normal array<double>, intercept double, sample long"
)
NODE = ["series_id", "tree", "root"]


def average_path(n: np.ndarray) -> np.ndarray:
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def tree_samples(rows: DataFrame, options: OutlierOptions) -> DataFrame:
    """Rows with the trees they train.

    A hash deals the rows of a series into groups of the sample size, one tree per group; more
    hashes deal again until all trees have a group. Rows are emitted only for trees that exist.
    """
    sizes = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    size = F.lit(options.sample_size) if options.sample_size else F.floor(F.col("_n") * SAMPLE_SHARE)
    if options.max_sample_rows:
        size = F.least(size, F.lit(options.max_sample_rows))
    size = F.greatest(F.least(size, F.col("_n")), F.lit(1))
    dealt = sizes.withColumn("_groups", F.greatest(F.floor(F.col("_n") / size), F.lit(1))).withColumn(
        "_deals", F.ceil(F.lit(options.n_trees) / F.col("_groups"))
    )
    wide = attach_checked(rows, dealt).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)))
    group = F.pmod(F.xxhash64("series_id", "ts", "_deal", F.lit(options.seed)), F.col("_groups"))
    tree = (F.col("_deal") * F.col("_groups") + group).cast("int")
    return wide.withColumn("tree", tree).where(F.col("tree") < options.n_trees).select("series_id", "tree", "ts", *FOREST_FEATURES)


def draw_cuts(low: np.ndarray, high: np.ndarray, rng: np.random.Generator, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each box a random direction over `level + 1` of the features, and where it cuts the box."""
    normal = rng.normal(size=low.shape)
    if (unused := low.shape[1] - level - 1) > 0:
        normal[rng.permuted(np.tile(np.arange(low.shape[1]), (len(low), 1)), axis=1) < unused] = 0.0
    return normal, np.einsum("ij,ij->i", normal, low + (high - low) * rng.random(low.shape))


def generator(seed: int, series: str, tree: int, root: int) -> np.random.Generator:
    own = [seed, tree, zlib.crc32(series.encode())]
    return np.random.default_rng([*own, root] if root else own)


def grow_tree(x: np.ndarray, rng: np.random.Generator, level: int, depth_limit: int, depth: int = 0) -> dict[str, np.ndarray]:
    """Columns of the nodes of a (sub)tree, level by level: node, left, right, size, depth, normal, intercept; leaves have left -1."""
    made, number, start = 1, np.zeros(1, np.int64), np.zeros(1, np.int64)  # x holds the rows of the level's nodes, node after node
    done: list[tuple[np.ndarray, ...]] = []
    while len(number):
        size = np.diff(np.append(start, len(x)))
        low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        normal, at = draw_cuts(low, high, rng, level)
        of = np.repeat(np.arange(len(number)), size)
        below = np.einsum("ij,ij->i", x, normal[of]) <= at[of]
        under = np.add.reduceat(below.astype(np.int64), start)
        inner = (size > 1) & (depth < depth_limit) & ~np.all(low == high, axis=1) & (under > 0) & (under < size)
        left = np.where(inner, made + 2 * (np.cumsum(inner) - 1), -1)
        right = np.where(inner, left + 1, -1)
        normal[~inner], at[~inner] = 0.0, 0.0
        done.append((number, left, right, size, np.full(len(number), depth), normal, at))
        kept = inner[of]
        x, side = x[kept], 2 * of[kept] + ~below[kept]
        x = x[np.argsort(side, kind="stable")]
        sizes = np.column_stack([under, size - under])[inner].ravel()
        start, number = np.cumsum(sizes) - sizes, np.column_stack([left, right])[inner].ravel()
        made, depth = made + len(number), depth + 1
    names = ("node", "left", "right", "size", "depth", "normal", "intercept")
    return dict(zip(names, map(np.concatenate, zip(*done))))


def split_large(rows: DataFrame, seed: int, level: int, task_rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Split nodes of more than `task_rows` rows level by level: the nodes, and the rows of what is left, as written tables.

    `rows` carry `series_id, tree, root, sample, limit` and the features; what is left has at most
    `task_rows` rows a (tree, root), with the `depth` of its root. A node at the depth limit, of equal
    rows, or whose cut leaves a side empty is a leaf, as in `grow_tree`.
    """
    lows, highs = [f"low_{f}" for f in FOREST_FEATURES], [f"high_{f}" for f in FOREST_FEATURES]
    spark, places = rows.sparkSession, {"nodes": table_path(rows.sparkSession), "rest": table_path(rows.sparkSession)}
    add = lambda what, df: df.write.mode("append").parquet(places[what])
    rows, depth = written(rows), 0
    made = cut_lineage(rows.select("series_id", "tree").distinct().withColumn("made", F.lit(1).cast("long")))
    leaf = [F.lit(-1).cast("long").alias("left"), F.lit(-1).cast("long").alias("right")]
    flat = [F.array(*[F.lit(0.0) for _ in FOREST_FEATURES]).alias("normal"), F.lit(0.0).alias("intercept")]
    name = [F.col("series_id"), F.col("tree"), F.shiftleft("root", LOCAL_BITS).alias("node")]

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = [draw_cuts(lo[None], hi[None], generator(seed, s, int(t), int(r) + (1 << 40)), level) for s, t, r, lo, hi in zip(
                batch["series_id"], batch["tree"], batch["root"], batch[lows].to_numpy(float), batch[highs].to_numpy(float))]
            out = batch[[*NODE, "n"]].copy()
            out["normal"], out["intercept"] = [n[0].tolist() for n, _ in drawn], [float(at[0]) for _, at in drawn]
            yield out

    while True:
        ends = [f(c).alias(f"{side}_{c}") for side, f in (("low", F.min), ("high", F.max)) for c in FOREST_FEATURES]
        boxes = cut_lineage(rows.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n"), F.first("sample").alias("sample"), F.first("limit").alias("limit"), *ends))
        same = reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in zip(lows, highs)])
        large = boxes.where(F.col("n") > task_rows).withColumn("_leaf", same | (F.col("limit") <= depth))
        add("rest", attach(rows, boxes.where(F.col("n") <= task_rows).select(*NODE), NODE, "inner").withColumn("depth", F.lit(depth)))
        leaves = lambda df: df.select(*name, *leaf, F.col("n").alias("size"), F.lit(depth).alias("depth"), *flat, "sample")
        add("nodes", leaves(large.where("_leaf")))
        drawn = cut_lineage(large.where(~F.col("_leaf")).mapInPandas(
            cuts, "series_id string, tree int, root long, n long, normal array<double>, intercept double"))
        if drawn.isEmpty():
            delete_written(rows)
            return tuple([spark.read.parquet(place)] for place in places.values())
        side = reduce(lambda x, y: x + y, [F.col(f) * F.col("normal")[i] for i, f in enumerate(FOREST_FEATURES)])
        moved = written(attach(rows, drawn.drop("n"), NODE, "inner").withColumn("_below", side <= F.col("intercept")).drop("normal", "intercept"))
        delete_written(rows)
        both = cut_lineage(moved.groupBy(*NODE).agg(F.count_if("_below").alias("_under"), F.first("sample").alias("sample")).join(drawn, NODE))
        halved = (F.col("_under") > 0) & (F.col("_under") < F.col("n"))
        add("nodes", leaves(both.where(~halved)))
        tree = Window.partitionBy("series_id", "tree")
        place = F.row_number().over(tree.orderBy("root")) - 1
        numbered = cut_lineage(both.where(halved).join(made, ["series_id", "tree"]).select(
            "*", (F.col("made") + 2 * place).alias("_first"), (F.col("made") + 2 * F.count(F.lit(1)).over(tree)).alias("_next")))
        add("nodes", numbered.select(
            *name, F.shiftleft("_first", LOCAL_BITS).alias("left"), F.shiftleft(F.col("_first") + 1, LOCAL_BITS).alias("right"),
            F.col("n").alias("size"), F.lit(depth).alias("depth"), "normal", "intercept", "sample"))
        made = cut_lineage(numbered.groupBy("series_id", "tree").agg(F.first("_next").alias("made")))
        child = F.col("_first") + F.when(F.col("_below"), 0).otherwise(1)
        rows = written(attach(moved, numbered.select(*NODE, "_first"), NODE, "inner").withColumn("root", child).drop("_below", "_first"))
        delete_written(moved)
        depth += 1


def train_forest(rows: DataFrame, options: OutlierOptions = OutlierOptions(), task_rows: int = TASK_ROWS) -> DataFrame:
    """Node table of all trees of all series; `rows` carry standardised forest features.

    The children of a node are named by their `node` number. Trees of up to `task_rows` rows take one
    task each; larger ones are split level by level until what is left is that small.
    """
    dims = len(FOREST_FEATURES)
    level = dims - 1 if options.extension_level is None else min(options.extension_level, dims - 1)
    seed, given = options.seed, options.max_tree_depth

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("ts")
        series, tree, root, sample, depth = (group[c][0].as_py() for c in ("series_id", "tree", "root", "sample", "depth"))
        sample = sample or len(group)  # zero: the group is the whole sample
        limit = given if given is not None else int(np.ceil(np.log2(max(sample, 2))))
        grown = grow_tree(matrix(group), generator(seed, series, tree, root), level, limit, depth)
        n, first = len(grown["node"]), root << LOCAL_BITS
        named = [grown["node"] + first, *(np.where(grown[c] < 0, -1, grown[c] + first) for c in ("left", "right"))]
        return pa.table([
            pa.repeat(series, n), pa.repeat(pa.scalar(tree, pa.int32()), n), *map(pa.array, named), pa.array(grown["size"]),
            pa.array(grown["depth"].astype(np.int32)), pa.ListArray.from_arrays(np.arange(0, dims * n + 1, dims, dtype=np.int32), grown["normal"].ravel()),
            pa.array(grown["intercept"]), pa.repeat(pa.scalar(sample, pa.int64()), n),
        ], names=["series_id", "tree", "node", "left", "right", "size", "depth", "normal", "intercept", "sample"])

    samples = tree_samples(rows, options).withColumn("root", F.lit(0).cast("long"))
    if not has_large_samples(rows, options, task_rows):
        whole = samples.withColumn("sample", F.lit(0).cast("long")).withColumn("depth", F.lit(0))
        return whole.groupBy(*NODE).applyInArrow(one, NODE_SCHEMA)
    sizes = samples.groupBy("series_id", "tree").agg(F.count(F.lit(1)).alias("sample"))
    limit = F.lit(given) if given is not None else F.ceil(F.log2(F.greatest(F.col("sample"), F.lit(2))))
    known = attach(samples, sizes.withColumn("limit", limit), ["series_id", "tree"], "inner")
    nodes, rest = split_large(known, seed, level, task_rows)
    small = reduce(DataFrame.unionByName, rest).drop("limit").groupBy(*NODE).applyInArrow(one, NODE_SCHEMA)
    return reduce(DataFrame.unionByName, nodes, small)


def has_large_samples(rows: DataFrame, options: OutlierOptions, task_rows: int) -> bool:
    """Can a tree of some series have more than `task_rows` rows? Decided from row counts: a hash group may be a little larger than its mean."""
    most = rows.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    mean = options.sample_size or most * SAMPLE_SHARE
    mean = min(mean, options.max_sample_rows or mean, most)
    return mean + 8 * mean**0.5 > task_rows and most > task_rows


def matrix(table: pa.Table) -> np.ndarray:
    return np.column_stack([table[c].to_numpy() for c in FOREST_FEATURES])


def path_lengths(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Path length of each row of `x` in one tree, relative to the tree's expected length; the nodes are in the order of their numbers."""
    number, normal, at = tree["node"], tree["normal"], tree["intercept"]  # ascending, not without gaps
    left, right = (np.where(tree[c] < 0, -1, np.searchsorted(number, tree[c])) for c in ("left", "right"))
    ends = (tree["depth"] + average_path(tree["size"])) / max(float(average_path(tree["sample"][0])), 1e-12)
    out = np.empty(len(x))
    for begin in range(0, len(x), BLOCK_ROWS):
        part = x[begin : begin + BLOCK_ROWS]
        here = np.zeros(len(part), dtype=np.int64)
        active = np.flatnonzero(left[here] >= 0)
        while len(active):
            node = here[active]
            node = np.where(np.einsum("ij,ij->i", part[active], normal[node]) <= at[node], left[node], right[node])
            here[active] = node
            active = active[left[node] >= 0]
        out[begin : begin + BLOCK_ROWS] = ends[here]
    return out


def trees_of(nodes: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    """The trees of a node table, one after the other, as arrays in the order of the nodes' numbers."""
    if not len(nodes):
        return
    columns = {c: nodes[c].to_numpy() for c in ("tree", "node", "left", "right", "size", "depth", "intercept", "sample")}
    columns["normal"] = pa.concat_arrays(c.flatten() for c in nodes["normal"].chunks).to_numpy().reshape(len(nodes), -1)
    order = np.lexsort((columns["node"], columns["tree"]))
    for members in np.split(order, np.flatnonzero(np.diff(columns["tree"][order])) + 1):
        yield {c: a[members] for c, a in columns.items()}


def score_forest(rows: DataFrame, forest: DataFrame, block_rows: int = SCORE_ROWS, task_nodes: int = TASK_NODES) -> DataFrame:
    """Anomaly score in (0, 1) of each row under its series' forest: `series_id, ts, rn, score`.

    Rows meet the forest block by block, so a long series is scored by many tasks. The trees of a
    series come in stretches of about `task_nodes` nodes; a task holds one block and one stretch, and
    the path lengths of a row are added up over the stretches. Both tables are read several times, so
    they had better be written down.
    """
    sizes = forest.groupBy("series_id", "tree").agg(F.count(F.lit(1)).alias("_nodes"))
    before = Window.partitionBy("series_id").orderBy("tree").rowsBetween(Window.unboundedPreceding, 0)
    stretch = F.floor((F.sum("_nodes").over(before) - F.col("_nodes")) / task_nodes).alias("_stretch")
    stretches = cut_lineage(sizes.select("series_id", "tree", stretch))
    packed = attach_checked(forest, stretches, ["series_id", "tree"], "inner", spread_by="node")
    at = F.floor(F.col("rn") / block_rows).alias("_block")
    blocks = attach_checked(rows.select("series_id", "ts", "rn", *FOREST_FEATURES, at), stretches.groupBy("series_id").agg(F.max("_stretch").alias("_most")))
    blocks = blocks.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_most", F.lit(0).cast("long"))))).drop("_most")
    copies = attach_checked(packed, rows.select("series_id", at).distinct(), how="inner", spread_by="node")
    copies = copies.withColumnsRenamed({"series_id": "_of", "_block": "_at", "_stretch": "_part"})

    def one(points: pa.Table, nodes: pa.Table) -> pa.Table:
        x, total, trees = matrix(points), np.zeros(len(points)), 0
        for tree in trees_of(nodes):
            total += path_lengths(x, tree)
            trees += 1
        return points.select(["series_id", "ts", "rn"]).append_column("total", pa.array(np.rint(total * PATH_UNIT).astype(np.int64))).append_column(
            "trees", pa.array(np.full(len(points), trees, np.int32)))

    parts = blocks.groupBy("series_id", "_block", "_stretch").cogroup(copies.groupBy("_of", "_at", "_part")).applyInArrow(
        one, "series_id string, ts long, rn long, total long, trees int")
    # whole numbers: the same sum however the parts arrive
    length = F.sum("total") / F.lit(PATH_UNIT)
    return parts.groupBy("series_id", "ts", "rn").agg(length.alias("total"), F.sum("trees").alias("trees")).select(
        "series_id", "ts", "rn", F.when(F.col("trees") > 0, F.pow(F.lit(2.0), -F.col("total") / F.col("trees"))).alias("score"))


def written_features(indexed: DataFrame, time: str, value: str) -> DataFrame:
    """The raw features, which scaling, training and scoring read."""
    return written(forest_features(indexed, time, value).select("series_id", "ts", "rn", *FOREST_FEATURES))


def forest_scores(
    indexed: DataFrame,
    options: OutlierOptions = OutlierOptions(),
    model: tuple[DataFrame, DataFrame] | None = None,
    value: str = "value",
    time: str = "ts",
) -> DataFrame:
    """Scores from a fresh forest, or from a stored `(scaling, forest)`."""
    raw = written_features(indexed, time, value)
    scaling, forest = model or (cut_lineage(feature_scaling(raw)), None)
    rows = written(standardise(raw, scaling))
    delete_written(raw)
    return score_forest(rows, forest if forest is not None else written(train_forest(rows, options)))


def fit_forest(indexed: DataFrame, options: OutlierOptions = OutlierOptions(), value: str = "value") -> tuple[DataFrame, DataFrame]:
    """`(scaling, forest)` tables to store and score later points with."""
    raw = written_features(indexed, "ts", value)
    scaling = cut_lineage(feature_scaling(raw))
    return scaling, train_forest(standardise(raw, scaling), options)
