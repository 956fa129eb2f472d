"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """`(node, root)` for every node named in `links(a, b)`; the root is the smallest node reachable.

    Each round ties all larger neighbours of a node, then all smaller ones, to the smallest
    neighbour, until every node points at its root: about log(n) rounds on links of any shape. Only
    minima and joins on a node are used, so a node with very many links is never collected; a
    round's links are checkpointed. Null ends and links of a node to itself are ignored.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        edges = cut_lineage(
            joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select("v", "m")).distinct()
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
