"""Hard negatives by exact integer scores from a residue number system.

Vectors of integers are taken modulo several small primes, in residues around zero so small that a
sum of products stays below 2**24. Matrix products of residues are therefore exact in float32. The
residues of a score give the score itself by Chinese remaindering in balanced digits, as long as the
product of the primes exceeds twice the largest possible score; the norms of the vectors say how
many primes that takes.

All rows are dealt evenly to chunks and the anchors evenly to blocks; a task multiplies one chunk
with one block. Nothing is broadcast and no pair of rows becomes a Spark row: a task returns, for
each anchor, only the best rows of its chunk. Two passes are made, first for the positives of every
anchor, then for the negatives in the window of each positive's score.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.llm.common import stored

CHUNK, BLOCK = 1 << 15, 1 << 14  # rows and anchors of a task
TILE = 1 << 20  # scores held at a time
EXACT = 1 << 24  # integers up to here are exact in float32
SPAN = 1024  # components multiplied before residues are taken anew
MOST_SQUARES = float(1 << 61)  # a vector's sum of squares; scores then fit a long
FEWEST_CHUNKS = 16  # so that a small table is not one task


def primes(width: int, bound: int) -> list[int]:
    """Odd primes, largest first, whose product exceeds 2 * bound; sums of `width` products of residues are exact."""
    top = int(2 * sqrt(EXACT / max(1, min(width, SPAN)))) - 1
    chosen, product, p = [], 1, min(top, 1021)
    while product <= 2 * bound:
        while p < 3 or any(p % d == 0 for d in range(2, int(sqrt(p)) + 1)):
            p -= 1
            if p < 3:
                raise ValueError("not enough primes for such scores")
        chosen.append(p)
        product, p = product * p, p - 1
    return chosen


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo an odd prime in -(p-1)/2 .. (p-1)/2."""
    r = np.remainder(x, p)
    return np.where(r > p // 2, r - p, r)


def residues(vectors: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    return [balanced(vectors, p).astype(np.float32) for p in moduli]


def products(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """All inner products of the rows of two residue matrices, exact as int64."""
    digits: list[np.ndarray] = []
    for k, (a, b, p) in enumerate(zip(left, right, moduli)):
        total = np.zeros((len(a), len(b)), np.float32)
        for i in range(0, a.shape[1], SPAN):
            total += balanced(a[:, i : i + SPAN] @ b[:, i : i + SPAN].T, p)
        value = balanced(total.astype(np.int32), p)
        # mixed radix: what is left after the digits found so far, divided by the earlier primes
        for q, digit in zip(moduli[:k], digits):
            value = balanced((value - digit) * pow(q, -1, p), p)
        digits.append(value)
    out, weight = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for p, digit in zip(moduli, digits):
        out += digit.astype(np.int64) * weight
        weight *= p
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of longs as rows; a shorter list ends in zeros."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    out, sizes = np.zeros((len(flat), width), np.int64), flat.value_lengths().to_numpy().astype(np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(flat)), sizes), at] = flat.flatten().to_numpy()
    return out


LOWEST = np.iinfo(np.int64).min


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k largest entries of each row above LOWEST; ties go to the smaller column. Changes `scores`."""
    rows = np.arange(len(scores))
    out = []
    for _ in range(min(k, scores.shape[1])):
        col = scores.argmax(axis=1)
        top = scores[rows, col]
        ok = top > LOWEST
        if not ok.any():
            break
        out.append((rows[ok], col[ok], top[ok]))
        scores[rows, col] = LOWEST
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _pairs(anchors: DataFrame, rows: DataFrame, score, schema: str, width: int, moduli: list[int]) -> DataFrame:
    """Tiles of anchors and rows through `score(anchor table, slice, row ids, row labels, scores)`, which returns columns of `schema`."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")  # ties go to the smaller id
            ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
            a, b = (residues(_matrix(t["v"], width), moduli) for t in (left, right))
            high = max(1, min(len(labels), TILE // 256))
            wide = max(1, TILE // high)
            for i in range(0, left.num_rows, wide):
                for j in range(0, right.num_rows, high):
                    s = products([x[i : i + wide] for x in a], [x[j : j + high] for x in b], moduli)
                    parts.append(score(left.slice(i, wide), ids[j : j + high], labels[j : j + high], s))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
        return pa.table({n: pa.array(np.asarray(c, np.int64)) for n, c in zip(names, columns)})

    return anchors.groupBy("chunk", "block").cogroup(rows.groupBy("chunk", "block")).applyInArrow(task, schema)


def _same_label(left: pa.Table, ids: np.ndarray, labels: np.ndarray, s: np.ndarray, k: int) -> tuple:
    s[left["label"].to_numpy()[:, None] != labels] = LOWEST
    s[left["vec_id"].to_numpy()[:, None] == ids] = LOWEST
    row, col, top = best(s, k)
    return left["anchor"].to_numpy()[row], ids[col], top


def _in_windows(left: pa.Table, ids: np.ndarray, labels: np.ndarray, s: np.ndarray, k: int, low: int, high: int) -> tuple:
    s[left["label"].to_numpy()[:, None] == labels] = LOWEST
    positives = left["positives"].to_pylist()
    out = [(np.zeros(0, np.int64),) * 4]
    for place in range(max(map(len, positives), default=0)):
        # whole numbers of Python: low * p <= 100 * n <= high * p without overflow
        bounds = [(-(-low * p[place] // 100), high * p[place] // 100) if place < len(p) else (0, -1) for p in positives]
        floor_, ceiling = (np.array(x, np.int64)[:, None] for x in zip(*bounds))
        row, col, top = best(np.where((s >= floor_) & (s <= ceiling), s, LOWEST), k)
        out.append((left["anchor"].to_numpy()[row], np.full(len(row), place), ids[col], top))
    return tuple(np.concatenate(x) for x in zip(*out))


def vectors(rows: DataFrame, scale: int = 256, id_column: str = "vec_id", label: Column | str = "label", embedding: str = "embedding") -> DataFrame:
    """`(vec_id, label, v)`: whole numbers floor(scale * x) of each row that takes part.

    Rows without an id, label or vector, or with a component that is null or not finite, take no
    part; neither does a vector whose sum of squares reaches 2**61, since its scores are no longs.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    x = F.transform(F.col(f"`{embedding}`"), lambda c: c.cast("double") * scale)
    whole = rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    squares = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + F.floor(c).cast("double") * F.floor(c).cast("double"))
    whole = whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return whole.where((F.size("x") == 0) | (squares < MOST_SQUARES)).select("vec_id", "label", F.transform("x", lambda c: F.floor(c).cast("long")).alias("v"))


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, chunk: int = CHUNK, block: int = BLOCK,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)` from `vectors(...)`.

    Anchors are the rows with `is_anchor`; the score of two rows is their inner product, a shorter
    vector ending in zeros. An anchor's positives are the `n_positives` rows of its label with the
    highest scores, rows of its own id apart; the negatives of a positive are the `n_negatives` rows of
    other labels with the highest scores from low to high percent of the positive's score. Ties go to
    the smaller id. Each of several rows with one id counts on its own, as an anchor, positive or
    negative. Anchors without positives, and positives without negatives, give no rows.
    """
    rows = stored(rows)
    size = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda acc, c: acc + c * c)), F.sum(is_anchor.cast("int"))).first()
    width, bound = max(1, size[1] or 0), (size[2] or 0) + 1
    chunks, blocks = max(FEWEST_CHUNKS, ceil(size[0] / chunk)), max(1, ceil((size[3] or 0) / block))
    moduli = primes(width, bound)
    # numbered within the tasks of the scan, so that chunks and blocks are even whatever the ids are
    dealt = rows.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    anchors = stored(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()))

    def everywhere(df: DataFrame) -> DataFrame:
        df = df.withColumn("block", F.pmod("anchor", F.lit(blocks)).cast("int"))
        return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    near = _pairs(everywhere(anchors), dealt, lambda *a: _same_label(*a, n_positives), "anchor long, id long, score long", width, moduli)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found"))  # n_positives at most
    listed = stored(listed.select("anchor", F.col("found.id").alias("ids"), F.col("found.score").alias("positives")))
    wanted = stored(anchors.join(listed, "anchor"))
    far = _pairs(
        everywhere(wanted.select("vec_id", "label", "v", "anchor", "positives")), dealt, lambda *a: _in_windows(*a, n_negatives, low, high),
        "anchor long, place long, id long, score long", width, moduli)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    named = wanted.select("anchor", F.col("vec_id").alias("anchor_id"), "ids", "positives")
    at = lambda name: F.element_at(name, (F.col("place") + 1).cast("int"))
    return far.join(named, "anchor").select("anchor_id", at("ids").alias("positive_id"), "rank", F.col("id").alias("negative_id"), at("positives").alias("positive_score"), F.col("score").alias("negative_score"))
