"""Token counts of flat, unindexed token files by a separator scan.

A flat file is nothing but token ids of a fixed width, one document after the other, each closed by
an end-of-document id. It is read in blocks; within a block all separators are found by one
vectorised comparison, which gives the lengths of the documents inside and what hangs over at both
ends. Prefix scans over the blocks of a file, and over the files of a sequence, then place every
block: a document's count is the distance between its separator and the last one before it, also
when that lies many blocks, or files, back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricwatch.llm.common import stored
from metricwatch.llm.spm import _content

BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, path: str, model_path: str | None = None, eod: int = 2, text: str = "text") -> None:
    """Write the texts' token ids as flat little-endian 16-bit files, one per task, `eod` after each document.

    Spark's text writer puts the bytes down as they are, and the two bytes of `eod` between rows, so
    they must be below 128. A null text is an empty document. The vocabulary must fit 16 bits.
    """
    content = docs.sparkSession.sparkContext.broadcast(_content(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content.value)
        if model.vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        for batch in batches:
            # text by text: the library's lists of ids take many times the room of the bytes
            ids = [np.array(model.encode(t.as_py() or ""), "<u2").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    rows = docs.select(text).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.option("lineSep", eod.to_bytes(2, "little").decode("ascii")).text(path)


def scan_block(tokens: np.ndarray, eod: int) -> tuple[int, list[int]]:
    """Number of tokens of a block and the places of its separators."""
    return len(tokens), np.flatnonzero(tokens == eod).tolist()


def count_tokens(spark: SparkSession, path: str, eod: int = 2, width: int = 2, block_tokens: int = BLOCK_TOKENS, joined: bool = False) -> DataFrame:
    """`(file, ordinal, start, n_tokens, closed)` of every document of the flat files below `path`.

    `ordinal` counts documents of a file from 0, `start` is the token where the document begins,
    `n_tokens` leaves the separator out. Tokens after a file's last separator are one document more,
    with `closed` false. With `joined` the files in order of their names are one stream: a document may
    run on into later files; it is listed under the file that closes it, with a negative `start`
    counted from that file's beginning, and only the stream's last may be open. Files must be below
    2 GB, the limit of Spark's binary source; empty files hold nothing. A length that is no multiple
    of the width is an error.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                buffer = content.as_buffer()
                if len(buffer) % width:
                    raise ValueError(f"{name} is no whole number of tokens")
                tokens = np.frombuffer(buffer, kind)
                found = [scan_block(tokens[i : i + block_tokens], eod) for i in range(0, len(tokens), block_tokens)]
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name.as_py()] * len(found)), pa.array(range(len(found)), pa.int32()),
                        pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.int64())),
                    ], names=["file", "block", "n", "places"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    blocks = stored(files.mapInArrow(run, "file string, block int, n long, places array<long>"))
    # first scan: where a block begins in its file, which document it begins with, what the last separator before it was
    within = W.partitionBy("file").orderBy("block")
    earlier = within.rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    blocks = blocks.withColumn("begin", begin).withColumn("last", F.when(F.size("places") > 0, F.col("begin") + F.element_at("places", -1) + 1))
    blocks = blocks.withColumn("ordinal", F.coalesce(F.sum(F.size("places")).over(earlier), F.lit(0)))
    blocks = blocks.withColumn("open_since", F.coalesce(F.max("last").over(earlier), F.lit(0)))
    # second scan: over one row a file, how many tokens of earlier files wait for a separator
    sums = blocks.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum(F.size("places")).alias("closed"))
    sums = sums.withColumn("tail", F.col("n") - F.coalesce("last", F.lit(0)))
    if joined:
        stream = W.orderBy("file")
        end = F.sum("n").over(stream)
        sums = sums.withColumn("end", end).withColumn("stop", F.when(F.col("last").isNotNull(), F.col("end") - F.col("n") + F.col("last")))
        sums = sums.withColumn("stopped", F.coalesce(F.max("stop").over(stream.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        sums = sums.withColumn("carry", F.col("end") - F.col("n") - F.col("stopped")).withColumn("final", F.lead("file").over(stream).isNull())
    else:
        sums = sums.withColumn("carry", F.lit(0).cast("long")).withColumn("final", F.lit(True))
    placed = blocks.join(sums.select("file", "carry"), "file")
    since = F.when(F.col("open_since") == 0, -F.col("carry")).otherwise(F.col("open_since"))
    # each separator with the place after the one before it, so that exploded rows carry no array
    pairs = F.transform("places", lambda p, i: F.struct(
        (F.col("begin") + p).alias("end"), F.when(i == 0, F.col("since")).otherwise(F.col("begin") + F.get("places", i - 1) + 1).alias("start"), i.alias("i")))
    ends = placed.withColumn("since", since).withColumn("pairs", pairs).select("file", "ordinal", F.explode_outer("pairs").alias("d"))
    closed = ends.where("d IS NOT NULL").select(
        "file", (F.col("ordinal") + F.col("d.i")).cast("long").alias("ordinal"), "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"),
        F.lit(True).alias("closed"))
    begins = F.coalesce("last", -F.col("carry"))
    rest = sums.where(F.col("final") & (F.col("n") > begins)).select(
        "file", F.col("closed").cast("long").alias("ordinal"), begins.alias("start"), (F.col("n") - begins).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)
