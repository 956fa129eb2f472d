"""Shards along a Hilbert curve: built-in expressions only.

Several metadata columns are quantised to a few bits each, so that values cut the rows about evenly.
The cells of this grid are walked along a Hilbert curve, rows are ranked by (curve index, id) and the
ranks are cut into runs of equal length. Rows close in several columns end up in few files, so
statistics of any of these columns prune files.

A row's rank is the number of rows in cells before its own, plus that in buckets of its cell before
its own, plus its place in its bucket. A bucket holds a stretch of a cell by a hash of the id, and a
cell has as many buckets as its size asks for, so a cell with a third of all rows is shared by many
tasks. Only ids, sizes and grid places are shuffled; texts stay where they are until files are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricwatch.llm.common import stored

BUCKET_ROWS = 20_000  # rows that are ranked together, on average
BROADCAST_CELLS = 1 << 18  # cells of the grid: bounded by its bits, 2 ** (bits * columns)


def hilbert_index(places: Sequence[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve through a grid of 2 ** bits cells a side.

    Bit by bit from the top: reflections and swaps of lower bits are applied to the coordinates as
    they are met, then the Gray code of the rotated coordinates is undone.
    """
    n = len(places)
    start = F.array(*[p.cast("long") for p in places])

    def exchange(x: Column, q: Column, i: int) -> Column:
        low = q - 1
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
        flipped = F.array(x[0].bitwiseXOR(low), *[x[k] for k in range(1, n)])
        swapped = F.array(*[x[k].bitwiseXOR(swap) if k in (0, i) and i > 0 else x[k] for k in range(n)])
        return F.when(x[i].bitwiseAND(q) != 0, flipped).otherwise(swapped)

    steps = F.flatten(F.transform(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), lambda b: F.array(
        *[F.struct(F.call_function("shiftleft", F.lit(1).cast("long"), b).alias("q"), F.lit(i).alias("i")) for i in range(n)]))) if bits > 1 else F.array()

    def step(x: Column, s: Column) -> Column:
        out = exchange(x, s["q"], n - 1)
        for i in reversed(range(n - 1)):
            out = F.when(s["i"] == i, exchange(x, s["q"], i)).otherwise(out)
        return out

    x = F.aggregate(steps, start, step) if bits > 1 else start
    gray = F.aggregate(F.slice(x, 2, n - 1), F.array(x[0]), lambda done, v: F.concat(done, F.array(F.element_at(done, -1).bitwiseXOR(v))))
    # undo the Gray code along the bits: parities of the last coordinate's higher bits
    parity = F.aggregate(
        F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>"), F.lit(0).cast("long"),
        lambda t, b: F.when(F.element_at(gray, -1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0,
                            t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)).otherwise(t))
    turned = F.transform(gray, lambda v: v.bitwiseXOR(parity))
    index = F.lit(0).cast("long")
    for b in reversed(range(bits)):
        for k in range(n):
            index = index * 2 + F.shiftright(turned[k], b).bitwiseAND(1)
    return index


def _quantised(rows: DataFrame, columns: Sequence[str], bits: int) -> DataFrame:
    """Add `__k0`, `__k1`, ...: the column's quantile step, 0 for null.

    Numbers are cut at approximate quantiles. Other values are counted, and the running share of
    rows in value order gives the step; their distinct values are a table of their own, joined back.
    """
    steps = 1 << bits
    for k, name in enumerate(columns):
        kind = rows.schema[name].dataType
        value = F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            cuts = rows.agg(F.percentile_approx(value, [i / steps for i in range(1, steps)], 10_000)).first()[0] or []
            rows = rows.withColumn(f"__k{k}", F.coalesce(F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < value)) if cuts else F.lit(0), F.lit(0)))
        else:
            counts = stored(rows.where(value.isNotNull()).groupBy(value.cast("string").alias("__v")).agg(F.count("*").alias("__n")))
            # values are dealt by their first character, so a long list of values is not ordered in one task
            first = F.substring("__v", 1, 2)
            heads = counts.groupBy(first.alias("__f")).agg(F.sum("__n").alias("__m"))
            heads = heads.select("__f", (F.sum("__m").over(W.orderBy("__f")) - F.col("__m")).alias("__before"))
            total = F.lit(counts.agg(F.sum("__n")).first()[0] or 1)
            place = F.col("__before") + F.sum("__n").over(W.partitionBy("__f").orderBy("__v")) - F.col("__n")
            table = counts.withColumn("__f", first).join(heads, "__f").select("__v", F.floor(place * steps / total).cast("int").alias(f"__k{k}"))
            rows = rows.join(F.broadcast(table) if counts.count() <= BROADCAST_CELLS else table, value.cast("string") == F.col("__v"), "left").drop("__v")
            rows = rows.withColumn(f"__k{k}", F.coalesce(f"__k{k}", F.lit(0)))
    return rows


def assign(
    docs: DataFrame, shards: int, columns: Sequence[str] = ("source", "lang", "n_chars"), bits: int = 4, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`(id, size, text_crc32, cell, shard, slot)`: row counts of any two shards differ by at most one.

    `size` is the text's UTF-8 length plus one and 1 for a null text. Rows with equal ids, or without
    one, are ordered by size and checksum; rows alike in all of these may change places, which
    changes nothing. Null metadata count as the lowest step.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)],
    )
    rows = stored(rows)
    rows = _quantised(rows, [f"__c{i}" for i in range(len(columns))], bits)
    keys = [f"__k{i}" for i in range(len(columns))]
    grid = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("cell", hilbert_index([F.col(k) for k in keys], bits)))
    total = grid.agg(F.sum("n")).first()[0] or 0
    before = (F.sum("n").over(W.orderBy("cell")) - F.col("n")).alias("cell_before")  # at most 2 ** (bits * columns) cells
    cells = grid.select(*keys, "cell", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("buckets"), before)
    placed = rows.join(F.broadcast(cells) if 1 << (bits * len(columns)) <= BROADCAST_CELLS else cells, keys)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.col("buckets")).cast("int"))
    sizes = placed.groupBy("cell", "bucket").agg(F.count("*").alias("m"))
    sizes = sizes.select("cell", "bucket", (F.sum("m").over(W.partitionBy("cell").orderBy("bucket")) - F.col("m")).alias("bucket_before"))
    inside = F.row_number().over(W.partitionBy("cell", "bucket").orderBy("id", "size", "text_crc32")) - 1
    ranked = placed.withColumn("inside", inside).join(sizes, ["cell", "bucket"])
    rank = (F.col("cell_before") + F.col("bucket_before") + F.col("inside")).cast("long")
    placed = ranked.select("id", "size", "text_crc32", "cell", rank.alias("rank"))
    # shard s holds the ranks from ceil(s * total / shards) on
    placed = placed.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)"))
    return placed.select("id", "size", "text_crc32", "cell", "shard", F.expr(f"rank - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"))


def write(docs: DataFrame, assigned: DataFrame, path: str, files_per_shard: int = 8, id_column: str = "doc_id") -> None:
    """Write the documents as one folder per shard, each file a stretch of the curve.

    `files_per_shard` bounds what one task sorts and writes. Ids must be unique; texts are shuffled once.
    """
    per_file = F.col("slot") * files_per_shard / F.lit(1)
    sizes = {r["shard"]: r["n"] for r in assigned.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    most = max(sizes.values(), default=1)
    part = assigned.select(F.col("id").alias("__id"), "shard", "slot", F.floor(per_file / most).cast("int").alias("__file"))
    joined = docs.join(part, docs[id_column] == F.col("__id")).drop("__id")
    joined.repartition(max(1, len(sizes) * files_per_shard), "shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)
