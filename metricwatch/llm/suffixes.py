"""Repeated byte strings by external induced suffix sorting of shards.

Windows of WINDOW bytes are dealt to shards by their anchor (see `anchors`), so equal windows meet in
one shard and a text whose anchors occur nowhere else goes to none. Equal runs of windows are counted
before they travel; a shard holds each different run once, with its number of copies.

A shard's suffixes are sorted by induction: suffixes that begin a rise (LMS) are put in order, then
every other suffix is placed from the one behind it, in two sweeps over the alphabet. The sweeps take
suffix tuples from a priority queue by first byte, first in first out within a byte; the queue keeps
a bounded number of tuples in memory and the rest in files of the task's own temporary folder, which
go with the task. Neighbours in suffix order whose common prefix reaches the window are repeats; the
common prefix is compared by a hash and then byte by byte.

The order of the LMS suffixes themselves comes from doubling their names, at most log2(window) times,
in place of recursion: no order beyond the window is ever needed.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.anchors import BYTE_VALUES, Prefix, byte_units, keyed, opened, run_table
from metricwatch.llm.common import stored

WINDOW = 200
GRAM = 32
SHARD_BYTES = 8 << 20  # a shard is closed at the next anchor once it is this long
QUEUE_TUPLES = 4 << 20  # suffix tuples of one queue in memory
STEP = 1 << 20  # units hashed at a time; a shard's suffixes are 32-bit numbers, so it takes some 30 bytes a byte
HOT_KINDS = 30_000  # anchors with more different runs than this are split window by window


class ByteQueue:
    """Suffixes by first byte, first in first out within a byte; beyond `room` they wait on disk."""

    def __init__(self, folder: str, room: int = QUEUE_TUPLES) -> None:
        self.folder, self.room, self.held = folder, room, 0
        self.memory: dict[int, list[np.ndarray]] = {}

    def push(self, first: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(first, kind="stable")
        first, suffixes = first[order], suffixes[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(first)]):
            self.memory.setdefault(int(first[a]), []).append(suffixes[a:b])
        self.held += len(suffixes)
        if self.held > self.room:
            for byte, blocks in self.memory.items():
                with open(os.path.join(self.folder, f"{id(self)}-{byte}"), "ab") as file:
                    for block in blocks:
                        file.write(block.tobytes())
            self.memory, self.held = {}, 0

    def pop(self, byte: int) -> np.ndarray:
        """All suffixes waiting under a byte, in the order they came."""
        path, blocks = os.path.join(self.folder, f"{id(self)}-{byte}"), []
        if os.path.exists(path):
            blocks.append(np.fromfile(path, np.int32))
            os.remove(path)
        held = self.memory.pop(byte, [])
        self.held -= sum(map(len, held))
        blocks += held
        return np.concatenate(blocks) if blocks else np.zeros(0, np.int32)


def _rises(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last, a single smallest unit, counts as such."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:]).astype(np.int32)
    kind = np.ones(n, bool)
    if len(differs):
        kind[: differs[-1] + 1] = np.repeat(text[differs] < text[differs + 1], np.diff(differs, prepend=np.int32(-1)))
    return kind


def _induce(text: np.ndarray, rises: np.ndarray, lms: np.ndarray, folder: str, room: int) -> np.ndarray:
    """All suffixes in order, from the suffixes `lms` that begin a rise, in order."""
    units = int(text.max()) + 1
    seeds = ByteQueue(folder, room)
    seeds.push(text[lms], lms)
    falling, queue = [], ByteQueue(folder, room)
    for unit in range(units):
        batch, done = queue.pop(unit), []
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            before = before[~rises[before]]
            first = text[before]
            batch = before[first == unit]
            queue.push(first[first > unit], before[first > unit])
        falling.append(np.concatenate(done) if done else np.zeros(0, np.int32))
        begin = seeds.pop(unit)
        before = begin[begin > 0] - 1
        queue.push(text[before], before)
    rising: list[np.ndarray] = [np.zeros(0, np.int32)] * units
    queue = ByteQueue(folder, room)
    for unit in reversed(range(units)):
        batch, done = queue.pop(unit), []
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            before = before[rises[before]]
            first = text[before]
            batch = before[first == unit]
            queue.push(first[first < unit], before[first < unit])
        if done:
            rising[unit] = np.concatenate(done)[::-1]
        down = falling[unit][::-1]
        before = down[down > 0] - 1
        before = before[rises[before]]
        queue.push(text[before], before)
    rising[0] = np.array([len(text) - 1], np.int32)
    return np.concatenate([x for unit in range(units) for x in (falling[unit], rising[unit])])


def _stretch_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of the text; starts and ends ascend."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        begin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + STEP, "right")))
        part = text[begin : int(ends[j - 1])]
        prefix = Prefix(BYTE_VALUES[part.astype(np.int64) % 256] ^ (part.astype(np.uint64) >> np.uint64(8)))
        out[i:j] = prefix.hashes(starts[i:j].astype(np.int64) - begin, ends[i:j].astype(np.int64) - begin)
        i = j
    return out


def _window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window of the bytes."""
    out = np.zeros(max(0, len(data) - window + 1), np.uint64)
    for i in range(0, len(out), STEP):
        part = Prefix(BYTE_VALUES[data[i : i + STEP + window - 1]]).grams(window)
        out[i : i + len(part)] = part
    return out


def suffix_order(text: np.ndarray, depth: int, folder: str, room: int = QUEUE_TUPLES) -> np.ndarray:
    """The suffixes of a sequence of small units in order of their first `depth` units at least.

    The last unit must be 0 and no other may be.
    """
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    rises = _rises(text)
    lms = (np.flatnonzero(rises[1:] & ~rises[:-1]) + 1).astype(np.int32)
    ordered = _induce(text, rises, lms, folder, room)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = ordered[is_lms[ordered]]  # in order of their stretches up to the next of their kind
    ordered = np.searchsorted(lms, ordered)
    ends = np.minimum(np.r_[lms[1:], np.int32(len(text) - 1)] + 1, len(text))
    content, length = _stretch_hashes(text, lms, ends)[ordered], (ends - lms)[ordered]
    name = np.cumsum(np.r_[False, (content[1:] != content[:-1]) | (length[1:] != length[:-1])]) + 1
    rank = np.zeros(len(lms), np.int64)
    rank[ordered] = name
    del ordered, ends, content, length, name
    step = 1
    while rank.max() < len(lms) and step < depth:
        behind = np.zeros(len(lms), np.int64)
        behind[:-step] = rank[step:]
        joint = rank * (len(lms) + 1) + behind
        order = np.argsort(joint, kind="stable")
        joint = joint[order]
        rank[order] = np.cumsum(np.r_[False, joint[1:] != joint[:-1]]) + 1
        step *= 2
    return _induce(text, rises, lms[np.argsort(rank, kind="stable")], folder, room)


def repeated_starts(pieces: list[bytes], counts: list[int], window: int, room: int = QUEUE_TUPLES) -> list[np.ndarray]:
    """For each piece, which of its first `counts[i]` windows equal another such window of any piece."""
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.zeros(sizes.sum() + 1, np.int16)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:-1] = data.astype(np.int16) + 2
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    text[begins + sizes - 1] = 1
    valid = np.zeros(len(text), bool)
    for begin, n in zip(begins.tolist(), counts):
        valid[begin : begin + n] = True
    with tempfile.TemporaryDirectory() as folder:
        order = suffix_order(text, window, folder, room)
    order = order[valid[order]]
    hashes = _window_hashes(data, window)
    near = np.concatenate([np.zeros(0, np.int64), *(
        i + np.flatnonzero(hashes[order[i + 1 : i + STEP + 1]] == hashes[order[i : i + STEP][: len(order) - 1 - i]]) for i in range(0, len(order) - 1, STEP))])
    again = np.zeros(len(text), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, window) if len(data) >= window else None
    for i in range(0, len(near), 20_000):
        a, b = order[near[i : i + 20_000]], order[near[i : i + 20_000] + 1]
        same = (windows[a] == windows[b]).all(axis=1)
        again[a[same]] = again[b[same]] = True
    return [again[begin : begin + n] for begin, n in zip(begins.tolist(), counts)]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)


def _fetched(rows: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """`(anchor, key, start, n, content)`: the bytes of the runs `(anchor, key, start, n)`."""
    per_doc = kinds.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, wanted in zip(*(batch.column(i) for i in range(3))):
                raw, flat = text.as_py().encode(), wanted.values
                begins, counts = flat.field(1).to_pylist(), flat.field(2).to_pylist()
                for i in range(0, len(begins), 20_000):
                    part = slice(i, i + 20_000)
                    content = [raw[a : a + n + window - 1] for a, n in zip(begins[part], counts[part])]
                    yield pa.RecordBatch.from_arrays([
                        flat.field(0)[part], pa.array([key.as_py()] * len(content), pa.int64()), flat.field(1)[part], flat.field(2)[part], pa.array(content, pa.binary()),
                    ], names=["anchor", "key", "start", "n", "content"])

    texts = rows.select("key", "text").join(per_doc, "key").select("key", "text", "runs")
    return texts.mapInArrow(run, "anchor long, key long, start int, n int, content binary")


def _sorted_shards(runs: DataFrame, window: int, shard_bytes: int, room: int) -> DataFrame:
    """`(key, start, n)`: stretches of repeated windows of the runs, which must be sorted by anchor in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            keys, starts, counts = [], [], []
            flags = repeated_starts([h[3] for h in held], [h[2] for h in held], window, room)
            for (key, start, _, _), again in zip(held, flags):
                if again.any():
                    begin, n = _stretches(again)
                    keys += [key] * len(begin)
                    starts += (begin + start).tolist()
                    counts += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())], names=["key", "start", "n"])

        for batch in batches:
            for anchor, key, start, n, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= shard_bytes and anchor != last:
                    yield from close()
                    held, size = [], 0
                held.append((key, start, n, content))
                size, last = size + len(content), anchor
        if held:
            yield from close()

    return runs.mapInArrow(run, "key long, start int, n int")


def _by_window(runs: DataFrame, window: int) -> DataFrame:
    """The same as `_sorted_shards` for runs of hot anchors: each window is dealt by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, key, start, n, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
                hashes = Prefix(BYTE_VALUES[np.frombuffer(content, np.uint8)]).grams(window)
                yield pa.RecordBatch.from_arrays([
                    pa.array([anchor] * n, pa.int64()), pa.array(hashes.view(np.int64)), pa.array([key] * n, pa.int64()), pa.array(range(start, start + n), pa.int32()),
                ], names=["anchor", "w", "key", "start"])

    windows = stored(runs.mapInArrow(run, "anchor long, w long, key long, start int"))
    often = windows.groupBy("anchor", "w").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "w")
    return windows.join(often, ["anchor", "w"], "left_semi").select("key", "start", F.lit(1).alias("n"))


def repeated_windows(
    rows: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, room: int = QUEUE_TUPLES, hot: int = HOT_KINDS
) -> DataFrame:
    """`(key, start, n)`: windows of the UTF-8 bytes of `(key, text)` that start anywhere else too."""
    found = run_table(rows.withColumn("rank", F.lit(0).cast("long")), byte_units, window, gram).drop("rank")
    often = found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    # stored first, so that both sides of the join are plain shuffles, which Spark splits where an anchor is frequent
    shared = opened(stored(found.join(stored(often), "anchor", "left_semi")))
    kinds = stored(shared.groupBy("anchor", "digest", "n").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("copies")))
    copied = kinds.where("copies > 1").select("anchor", "digest", "n")
    copied = shared.join(copied, ["anchor", "digest", "n"], "left_semi").select("key", "start", "n")
    variety = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("anchor")
    runs = stored(_fetched(rows, kinds.select("anchor", "n", "first.key", "first.start"), window))
    size = runs.agg(F.sum(F.length("content"))).first()[0] or 0
    hot_anchors = stored(variety)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    sharded = runs.join(hot_anchors, "anchor", "left_anti").repartition(parts, "anchor").sortWithinPartitions("anchor")
    alone = _sorted_shards(sharded, window, shard_bytes, room)
    if not hot_anchors.isEmpty():
        alone = alone.union(_by_window(runs.join(hot_anchors, "anchor", "left_semi"), window))
    return copied.union(alone)


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """`(id, n_bytes, n_removed, n_spans, kept)`: `kept` holds the bytes that stay.

    A byte goes if a window that covers it also starts elsewhere, in the same text or another;
    overlapping windows count. A null text is empty, a text shorter than the window loses nothing, and
    repeated rows are each other's copies. `kept` may cut a character in two, so it is binary.
    """
    rows = keyed(docs, id_column, text)
    gone = repeated_windows(rows, window, gram, **limits).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(1), batch.column(2)):
                data = np.frombuffer(body.as_py().encode(), np.uint8)
                change = np.zeros(len(data) + 1, np.int64)
                if spans.is_valid:
                    start, n = (spans.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n + window - 1, -1)
                covered = np.cumsum(change)[:-1] > 0
                out.append((len(data), int(covered.sum()), len(_stretches(covered)[0]), data[~covered].tobytes()))
            longs = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array([x[3] for x in out], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(gone, "key", "left").select("id", "text", "gone").mapInArrow(
        run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
