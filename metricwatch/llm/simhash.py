"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into two segments of 32. If two fingerprints differ in at most
three bits, one segment differs in at most one. Each distinct segment value is indexed under its 32
variants with one bit wiped out, and an equality grouping of variants gives all pairs of segment
values that differ in one bit; equal values come for free. Members of such a pair of values are
joined and verified on all 64 bits.

Equal fingerprints are merged first, so copies cost one row. Where very many different fingerprints
share a segment pair (a large group of near copies), pairs are not formed: every member names the
values of its other segment within one or two flips, and members that meet at a value are tied to
one of them. That costs a fixed number of rows per member, meets hold at most 529 members, and it
links exactly the members within three bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import stored
from metricwatch.llm.components import components

HEAVY = 500_000  # pairs of members above which a pair of segment values is linked by flips; the links are the same
CHUNK = 1 << 18  # shingles whose bits are counted at a time


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats counted."""
    tokens = (text or "").encode().lower().split()  # bytes.split() cuts at ASCII white space only
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """`(id, fp)` of each row; `fp` holds the 64 bits as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """`(seg, v, other, fp)`: both halves of each fingerprint, with the other half."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), high.alias("v"), low.alias("other")),
        F.struct(F.lit(1).alias("seg"), low.alias("v"), high.alias("other")),
    )
    return fps.select("fp", F.explode(halves).alias("h")).select("h.*", "fp")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _flip(value: Column, places: list[Column]) -> Column:
    for p in places:
        value = value.bitwiseXOR(_bit(p))
    return value


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """`(a, b)` between distinct fingerprints such that exactly those within three bits are connected.

    Light pairs of segment values give every link; heavy ones enough links to connect the same groups.
    """
    members = _segments(fps)
    values = members.groupBy("seg", "v").agg(F.count("*").alias("n"))
    places = F.sequence(F.lit(0), F.lit(31))
    variants = values.select(
        "seg", "v", F.explode(places).alias("p")
    ).select(
        (F.col("seg") * 32 + F.col("p")).cast("int").alias("place"),
        F.col("v").bitwiseAND(F.bitwise_not(_bit(F.col("p")))).alias("rest"),
        F.when(F.col("v").bitwiseAND(_bit(F.col("p"))) == 0, 1).otherwise(2).cast("tinyint").alias("side"),
    )
    near = variants.groupBy("place", "rest").agg(F.bit_or("side").alias("sides")).where("sides = 3").select(
        F.expr("place div 32").cast("int").alias("seg"), F.col("rest").alias("v0"),
        F.col("rest").bitwiseOR(_bit(F.col("place") % 32)).alias("v1"),
    )
    counts0 = values.select("seg", F.col("v").alias("v0"), F.col("n").alias("n0"))
    counts1 = values.select("seg", F.col("v").alias("v1"), F.col("n").alias("n1"))
    same = values.where("n > 1").select("seg", F.col("v").alias("v0"), F.col("v").alias("v1"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    pairs = stored(
        near.join(counts0, ["seg", "v0"]).join(counts1, ["seg", "v1"]).select("seg", "v0", "v1", (F.col("n0") * F.col("n1")).alias("pairs")).unionByName(same)
    )
    left = members.select("seg", F.col("v").alias("v0"), F.col("fp").alias("a"))
    right = members.select("seg", F.col("v").alias("v1"), F.col("fp").alias("b"))
    light = (
        pairs.where(F.col("pairs") <= heavy).join(left, ["seg", "v0"]).join(right, ["seg", "v1"])
        .where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3) & ((F.col("v0") < F.col("v1")) | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )
    hot = pairs.where(F.col("pairs") > heavy)
    if hot.isEmpty():
        return light
    ends = hot.select("seg", "v0", "v1", F.explode(F.array_distinct(F.array("v0", "v1"))).alias("v"))
    inside = ends.join(members, ["seg", "v"])
    once = F.concat(F.array("other"), F.transform(places, lambda p: _flip(F.col("other"), [p])))
    twice = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda p: F.transform(F.sequence(p + 1, F.lit(31)), lambda q: _flip(F.col("other"), [p, q]))))
    tag = lambda array, hub: F.transform(array, lambda x: F.struct(x.alias("x"), F.lit(hub).alias("hub")))
    keys = F.when(F.col("v0") == F.col("v1"), F.concat(tag(once, True), tag(twice, False))).otherwise(tag(once, True))
    met = inside.select("seg", "v0", "v1", "fp", F.explode(keys).alias("k")).groupBy("seg", "v0", "v1", "k.x").agg(
        F.min(F.when(F.col("k.hub"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("all")
    )
    tied = met.where(F.col("a").isNotNull() & (F.size("all") > 1)).select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return light.union(tied)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """`(id, fp, component, copies)` of each row: the smallest id linked to it through texts within three bits.

    Texts without words share fingerprint zero and are linked like any other. Rows with a null id get
    the component of their fingerprint but never name one; `copies` counts rows with the same fingerprint.
    """
    rows = stored(fingerprints(docs, id_column, text))
    groups = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(groups.select("fp"), heavy))
    tied = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    names = tied.groupBy("root").agg(F.min("least").alias("component"))
    named = tied.join(names, "root").select("fp", "component", "copies")
    return rows.join(named, "fp").select("id", "fp", "component", "copies")


def copies_to_drop(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of rows that are not the one document kept of their group (the one with the smallest id).

    Rows with a null id are not listed and stay; rows repeated under the kept id stay with it.
    """
    return near_duplicates(docs, id_column, text).where("id <> component").select("id").distinct()
