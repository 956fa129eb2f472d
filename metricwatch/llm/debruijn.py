"""Repeated word passages by compaction of a De Bruijn graph.

Edges of the graph are the 13-word sequences (k-mers) of the documents. Edges that follow each other
in a document and share their anchor (see `anchors`) leave it as one path. Equal paths of several
documents are merged by Spark; where all paths through an anchor are equal, the path does not branch
and is known by its first document alone. Only where paths through an anchor differ are they taken
apart into edges again, read from the source coordinates of one path of each kind, and merged edge
by edge. So almost all of a long shared passage travels as a few compacted paths.

A word goes if a window that covers it also starts in a document with a smaller id. Windows are
judged on the input. Rows without an id come after all others; texts of fewer words than a window
lose nothing; rows alike in id and text have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.anchors import Prefix, keyed, opened, run_table, word_units
from metricwatch.llm.common import release, stored

WINDOW = 13
GRAM = 4
LAST = (1 << 63) - 1


def _words(text: str | None) -> np.ndarray:
    return word_units(text)[0]


def _edges(rows: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """`(anchor, digest, n, edge, rank, at)` of the edges of the paths `(key, anchor, digest, start, n)`, read from the documents."""
    per_doc = paths.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "start", "n")).alias("paths"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, text, wanted in zip(*(batch.column(i) for i in range(3))):
                units = _words(text.as_py())
                edges = Prefix(units).grams(window)
                flat = wanted.values
                anchor, digest, start, n = (flat.field(i).to_numpy() for i in range(4))
                at = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(anchor, n)), pa.array(np.repeat(digest, n)), pa.array(np.repeat(n, n)),
                    pa.array(edges[np.repeat(start, n) + at].view(np.int64)), pa.array(np.full(len(at), rank.as_py(), np.int64)), pa.array(at.astype(np.int32)),
                ], names=["anchor", "digest", "n", "edge", "rank", "at"])

    return rows.join(per_doc, "key").select("rank", "text", "paths").mapInArrow(
        run, "anchor long, digest long, n int, edge long, rank long, at int")


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`(key, gone)`, stored: the windows `(start, n)` of `(key, rank, text)` that also start in a row of smaller rank."""
    found = run_table(rows, _words, window, gram)
    repeated = stored(found.groupBy("anchor").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a < b").select("anchor"))
    # stored first, so that both sides of the join are plain shuffles, which Spark splits where an anchor is frequent
    several = stored(found.join(repeated, "anchor", "left_semi"))
    release(repeated)
    shared = opened(several)
    # equal paths are one; its first document owns it
    paths = stored(shared.groupBy("anchor", "digest", "n").agg(F.min(F.struct("rank", "key", "start")).alias("first")))
    # where different paths share an anchor, the owners' paths are taken apart
    branching = stored(paths.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"))
    owners = stored(paths.join(branching, "anchor", "left_semi").select("anchor", "digest", "n", "first.key", "first.start"))
    release(branching)
    edges = stored(_edges(rows, owners, window))
    release(owners)
    later = stored(
        shared.join(paths.select("anchor", "digest", "n", F.col("first.rank").alias("owner")), ["anchor", "digest", "n"]).where("owner < rank").select("key", "start", "n"))
    release(paths)
    firsts = edges.groupBy("anchor", "edge").agg(F.min("rank").alias("owner"), F.max("rank").alias("latest")).where("owner < latest")
    old = stored(edges.join(firsts, ["anchor", "edge"]).where("owner < rank").select("anchor", "digest", "n", "rank", "at"))
    release(edges)
    # a path may come several times in its first document
    single = stored(shared.join(old, ["anchor", "digest", "n", "rank"]).select("key", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n")))
    release(several, old)
    gone = later.select("key", "start", "n").union(single).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("gone"))  # bounded by the text
    gone = stored(gone)
    release(later, single)
    return gone


def _without(text: str, starts: np.ndarray, n: np.ndarray, window: int) -> tuple[int, int, str]:
    _, begin, end, raw = word_units(text)
    change = np.zeros(len(begin) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n + window - 1, -1)
    covered = np.cumsum(change)[:-1] > 0
    kept = b" ".join(raw[a:b] for a, b in zip(begin[~covered].tolist(), end[~covered].tolist()))
    return len(begin), int(covered.sum()), kept.decode()


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, n_words, n_removed, kept)` of each row; `kept` joins the words that stay by one space."""
    rows = keyed(docs, id_column, text).withColumn("rank", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    gone = repeated_windows(rows, window, gram)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(1), batch.column(2)):
                flat = spans.values if spans.is_valid else None
                start, n = (flat.field(i).to_numpy().astype(np.int64) for i in range(2)) if flat is not None else (none, none)
                out.append(_without(body.as_py(), start, n, window))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()),
            ], names=["id", "n_words", "n_removed", "kept"])

    return rows.join(gone, "key", "left").select("id", "text", "gone").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")

