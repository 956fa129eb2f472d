"""Candidates for repeated windows: windows dealt by a sampled anchor they contain.

Of the short grams inside a window the one with the smallest hash is the window's anchor. Equal
windows have equal anchors at the same place, so windows whose anchor occurs nowhere else repeat
nowhere, and only the others need to be compared. Neighbouring windows mostly share their anchor;
they form one run, so a text of n units gives about 2 n / (window - gram + 2) runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STRETCH = 1 << 22  # windows handled at a time
PLACE_BITS = np.uint64(24)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, factor in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(max(n, 1 << 16), factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Prefix:
    """Hashes of any stretch of a sequence of 64-bit unit values."""

    def __init__(self, units: np.ndarray) -> None:
        up, self.down = powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[: len(self.sums) - size]) * self.down[: len(self.sums) - size])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows, hash of all units) of each run of a text."""
    parts = []
    for at in range(0, max(0, len(units) - window + 1), STRETCH):
        prefix = Prefix(units[at : at + STRETCH + window - 1])
        grams = prefix.grams(gram)
        # ties go to the leftmost gram, which equal windows agree on
        keys = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(keys, window - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        n = np.diff(np.r_[first, len(place)])
        parts.append((grams[place[first]], first + at, n, prefix.hashes(first, first + n + window - 1)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def word_units(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes, starts and ends of the words (cut at ASCII white space) of a text, and its bytes."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Prefix(BYTE_VALUES[data]).hashes(starts, ends), starts, ends, raw


def byte_units(text: str | None) -> np.ndarray:
    return BYTE_VALUES[np.frombuffer((text or "").encode(), np.uint8)]


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, id, text)`: the key names a row by its id and text, so rows alike share one and have the same result."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.xxhash64(F.col(f"`{id_column}`"), body).alias("key"), F.col(f"`{id_column}`").alias("id"), body.alias("text"))


def run_table(rows: DataFrame, units: Callable[[str | None], np.ndarray], window: int, gram: int) -> DataFrame:
    """`(key, rank, anchor, span, digest)` of every run of `(key, rank, text)`; rank is a long carried along.

    `span` holds the first window and the number of windows, see `opened`; it is packed to shuffle less.
    """
    if window >= 1 << 16:
        raise ValueError("windows are below 65,536 units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(units(t.as_py()), window, gram) for t in batch.column(2)]
            count = np.array([len(f[0]) for f in found])
            take = np.repeat(np.arange(len(found)), count)
            joined = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
            for i in range(0, len(take), 100_000):
                part, (anchor, start, n, digest) = take[i : i + 100_000], (x[i : i + 100_000] for x in joined)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)), pa.array(anchor.view(np.int64)),
                    pa.array(start.astype(np.int64) << 16 | n.astype(np.int64)), pa.array(digest.view(np.int64)),
                ], names=["key", "rank", "anchor", "span", "digest"])

    return rows.select("key", "rank", "text").mapInArrow(run, "key long, rank long, anchor long, span long, digest long")


def opened(runs: DataFrame) -> DataFrame:
    """The rows with `span` taken apart into `start` and `n`."""
    return runs.withColumns({"start": F.shiftright("span", 16).cast("int"), "n": F.col("span").bitwiseAND(0xFFFF).cast("int")}).drop("span")
