"""Near copies: SimHash links first, the rest by a prefix filter, all verified by the Jaccard similarity of word shingles.

Fingerprints of the same shingles that differ in three bits or fewer are linked by `simhash.links`
(deletion variants of segments); in crowded places it ties members to one of them, so links stay few.
At a similarity of 0.8 most fingerprints differ in more bits than any such index can bridge, so the
pairs that SimHash does not name come from an exact way, described next; nothing is missed.

The shingles of a text are put into one order that all texts share, rare ones first. If two texts of
sizes m <= n have a similarity of `share`, they have ceil(share / (1 + share) * (m + n)) shingles in
common, so one of the first m - ceil(2 * share / (1 + share) * m) + 1 shingles of the smaller text is
among the first n - ceil(share * n) + 1 of the larger (prefix filter). Candidates come from an
equality grouping of these, and only where enough shingles are left behind the common one (position
filter). Texts that share frequent passages only are therefore no candidates: their own, rarer
shingles fill the short prefix. What counts as rare is taken from a sample; it affects speed, never
the result.

Candidates then compare signatures: a bit for each residue of the hashes, set where an odd number of
shingles falls there. Two signatures differ in at most as many bits as the sets differ in shingles,
so more bits rule the pair out; it takes one bit a shingle. Only what is left compares whole sets,
which then travel once for each pair, to the smaller id.

Equal shingle sets are merged first. Where many texts share a prefix shingle (a large group of near
copies), members are compared with the smallest ids of the group that are still open: one at first,
which settles a group of copies, then eight times as many in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.llm.common import BROADCAST_IDS, release, stored
from metricwatch.llm.simhash import fingerprint, links as simhash_links

LIGHT = 64  # members of a shared shingle up to which all pairs are candidates
GROWTH = 8  # by which the number of first members that a large group is compared with grows in each round
SAMPLE = 20  # one of so many texts is looked at for frequent shingles
FREQUENT = 500_000  # frequent shingles sent to every worker: 16 bytes each
DRIVER_LINKS = 500_000  # near pairs up to which the driver decides which texts stay, in one loop
FOLLOWERS = 256  # sets that meet the set of a smaller id in one task, about
BATCH = 1_000  # rows whose sets a worker holds at a time
SIGNATURE = 1 << 15  # bits of a signature at most
CROWD = 2_000  # pairs of texts of one pair of fingerprint segments above which SimHash ties them to one


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) text's word shingles; a shorter text is one shingle."""
    tokens = (text or "").encode().lower().split()  # bytes.split() cuts at ASCII white space only
    if not tokens:
        return np.zeros(0, np.int64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(tokens))
    starts = (ends - lengths)[: len(tokens) - width + 1].tolist()
    spans = zip(starts, ends[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(starts)).view(np.int64))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """`(id, s)`: the shingles of each row of `docs(id, t)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                sets = pa.array([shingles(t.as_py(), width) for t in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["id", "s"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, s array<long>")


def needed(share: float, both: Column | int) -> Column | int:
    """Common shingles of two sets with a similarity of `share` and `both` shingles together."""
    part = share / (1 + share)
    return ceil(part * both - 1e-9) if isinstance(both, int) else F.ceil(both * part - 1e-9)


def parity(s: np.ndarray) -> np.ndarray:
    """The signature of a set of hashes: as many bits as there are shingles, to the next power of two, as longs."""
    bits = min(SIGNATURE, max(64, 1 << max(0, len(s) - 1).bit_length()))
    odd = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _features(docs: DataFrame, share: float, width: int) -> DataFrame:
    """`(id, sig, fp, n, short, prefix, bits)`: a hash of the shingle set, the SimHash fingerprint, its size, its first shingles and signature.

    The first `short` of `prefix` are those that count where the other text is at least as large.
    """
    sample = _sets(docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), width)
    often = sample.select(F.explode("s").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT)
    often = sorted((r[0], r[1]) for r in often.collect())
    known = docs.sparkSession.sparkContext.broadcast((np.array([h for h, _ in often], np.int64), np.array([c for _, c in often], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = known.value
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            sigs, fps, sizes, shorts, firsts, bits = [], [], [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), width)
                sigs.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                fps.append(fingerprint(t.as_py(), width))
                sizes.append(len(s))
                shorts.append(len(s) - needed(share, 2 * len(s)) + 1)
                bits.append(parity(s))
                rank = np.zeros(len(s), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    rank = np.where(hashes[at] == s, counts[at], 0)
                order = np.lexsort((s, rank))  # s is sorted as well: ties in the order of the hashes
                firsts.append(s[order[: len(s) - ceil(share * len(s) - 1e-9) + 1]])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(shorts, pa.int32()),
                pa.array(firsts, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
            ], names=["id", "sig", "fp", "n", "short", "prefix", "bits"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, sig long, fp long, n int, short int, prefix array<long>, bits array<long>")


def _linked(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct `(a, b)`, a < b, of `prints(id, fp)` that SimHash links; texts of one fingerprint are linked to the smallest id."""
    first = stored(prints.groupBy("fp").agg(F.min("id").alias("id")))
    tied = simhash_links(first.select("fp"), crowd)
    ends = [first.select(F.col("fp").alias(x), F.col("id").alias(f"id_{x}")) for x in ("a", "b")]
    across = tied.join(ends[0], "a").join(ends[1], "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).where("a < b")
    alike = prints.join(first.withColumnRenamed("id", "least"), "fp").select(F.col("least").alias("a"), F.col("id").alias("b")).where("a < b")
    pairs = stored(across.union(alike).distinct())
    release(first)
    return pairs


def _small(df: DataFrame) -> DataFrame:
    """Sent to every executor if a count shows at most BROADCAST_IDS rows of a few numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _candidates(members: DataFrame, others: DataFrame, share: float) -> DataFrame:
    """Distinct `(a, b)`, a < b, of a member and another of the same key that sizes and positions allow."""
    side = lambda df, x: df.select("key", F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "at", "early")])
    n_a, n_b, at_a, at_b = (F.col(c) for c in ("n_a", "n_b", "at_a", "at_b"))
    ahead = F.least(n_a - at_a, n_b - at_b)  # common at most: this one and what is left behind it
    short = F.when(n_a < n_b, F.col("early_a")).when(n_a > n_b, F.col("early_b")).otherwise(F.col("early_a") & F.col("early_b"))
    fit = (F.col("a") < F.col("b")) & (F.least(n_a, n_b) / F.greatest(n_a, n_b) >= share) & short & (ahead >= needed(share, n_a + n_b))
    return side(members, "a").join(side(others, "b"), "key").where(fit).select("a", "b").distinct()


def _alike(pairs: DataFrame, signatures: DataFrame, share: float) -> DataFrame:
    """The pairs whose signatures allow the similarity."""
    for x in ("a", "b"):
        pairs = pairs.join(signatures.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    size = F.least(F.size("bits_a"), F.size("bits_b"))

    def folded(name: str) -> Column:
        """A signature of twice the bits, or more, folded to the common size."""
        pieces = F.transform(F.sequence(F.lit(0), (F.size(name) / size).cast("int") - 1), lambda i: F.slice(name, i * size + 1, size))
        return F.when(F.size(name) == size, F.col(name)).otherwise(F.reduce(
            F.slice(pieces, 2, F.size(pieces)), pieces[0], lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))))

    differ = F.aggregate(F.zip_with(folded("bits_a"), folded("bits_b"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, k: acc + k)
    both = F.col("n_a") + F.col("n_b")
    return pairs.where(differ <= both - 2 * needed(share, both)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, signatures: DataFrame, share: float, width: int) -> DataFrame:
    """Of `pairs(a, b)` those with a similarity of at least `share`, stored."""
    pairs = stored(_alike(pairs, signatures, share))
    # a text with many partners is sent to several tasks, each of which takes a part of them
    spread = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")))
    dealt = stored(pairs.join(spread, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part"))
    first = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def with_sets(rows: DataFrame, name: str, out: str) -> DataFrame:
        wanted = rows.select(F.col(name).alias("id")).distinct()
        sets = _sets(docs.join(_small(wanted), "id", "left_semi").select("id", "t"), width)
        return _small(rows).join(sets.select(F.col("id").alias(name), F.col("s").alias(out)), name)

    x, y = with_sets(first, "a", "x"), with_sets(dealt, "b", "y")
    wide = x.join(y, ["a", "part"])
    wide = wide.select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("common"))
    near = stored(wide.where((F.col("common") >= share * (F.col("both") - F.col("common")) - 1e-9) | (F.col("both") == 0)).select("a", "b").distinct())
    release(pairs, spread, dealt)
    return near


def _without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)


def _decided(links: DataFrame) -> DataFrame:
    """The ids that go, from all near pairs still open: a pair takes its larger id away if the smaller one stays."""
    pairs = links.toArrow().sort_by("b")
    gone: dict = {}
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
        if a not in gone:
            gone[b] = None
    return links.sparkSession.createDataFrame(pa.table({"id": pa.array(list(gone), pairs.schema.field("a").type)}))


def copies_to_drop(
    docs: DataFrame, share: float = 0.8, width: int = 5, id_column: str = "doc_id", text: str = "text", light: int = LIGHT,
) -> DataFrame:
    """Ids of the rows dropped when, in order of the ids, a text stays unless one that stays is near it.

    So each text dropped is near one that stays, and no two that stay are near each other. Texts
    without words count as equal; rows with a null id are not listed and stay.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).where("id IS NOT NULL")
    rows = stored(_features(docs, share, width))
    one = stored(rows.groupBy("sig").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    out = [stored(rows.select("id", "sig").join(one.where("copies > 1").select("sig", F.col("id").alias("least")), "sig").where("id <> least").select("id").distinct())]
    kept = rows.join(_small(one.select("id", "sig")), ["id", "sig"], "left_semi")
    signatures = stored(kept.select("id", "n", "bits", "sig").dropDuplicates(["id", "sig"]))
    linked = _linked(kept.select("id", "fp").distinct())
    near = _verified(linked, docs, signatures, share, width)
    keyed = kept.select("id", "n", "short", F.posexplode("prefix").alias("at", "key"))
    keyed = keyed.select("key", "id", "n", "at", (F.col("at") < F.col("short")).alias("early"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("m"), F.max("early").alias("some")).where((F.col("m") > 1) & F.col("some")).select("key", "m"))
    members = stored(keyed.join(shared, "key"))
    release(rows, one, shared)
    pairs = stored(_candidates(members.where(F.col("m") <= light), members.where(F.col("m") <= light), share).join(linked, ["a", "b"], "left_anti"))
    rest = _verified(pairs, docs, signatures, share, width)
    links = stored(near.unionByName(rest))
    release(near, rest)
    heavy = stored(members.where(F.col("m") > light).drop("m"))
    release(members, pairs)
    open_ = stored(links.select(F.explode(F.array("a", "b")).alias("id")).union(heavy.select("id")).distinct())
    first = 1
    while not open_.isEmpty():
        crowded = not heavy.isEmpty()
        if not crowded and links.count() <= DRIVER_LINKS:
            out.append(_decided(links))
            break
        behind, done = links.select(F.col("b").alias("id")), [open_, links]
        if crowded:
            # the first open ids of each group meet all its others; ids that are among them in every group know all smaller ones
            place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
            leaders = stored(heavy.withColumn("place", place).where(F.col("place") <= first).drop("place"))
            last = leaders.groupBy("key").agg(F.max("id").alias("last"))
            later = stored(heavy.join(last, "key").where("id > last").select("id").distinct())
            pairs = stored(_candidates(leaders, heavy, share).join(linked, ["a", "b"], "left_anti"))
            found = _verified(pairs, docs, signatures, share, width)
            links = stored(links.unionByName(found).distinct())
            behind = links.select(F.col("b").alias("id")).union(later)
            done += [leaders, later, pairs, found, links]
            first *= GROWTH
        keep = stored(_without(open_, behind.distinct(), "id"))
        gone = stored(links.join(keep.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct())
        out.append(gone)
        settled = stored(keep.union(gone))
        open_, links = stored(_without(open_, settled, "id")), stored(_without(_without(links, settled, "a"), settled, "b"))
        if crowded:
            rest = stored(_without(heavy, settled, "id"))
            done.append(heavy)
            heavy = rest
        release(*done, keep, settled)
    gone = stored(reduce(DataFrame.union, out).distinct())
    release(signatures, linked, *[t for t in out if hasattr(t, "_stored_at")])
    return gone
