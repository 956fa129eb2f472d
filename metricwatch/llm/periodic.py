"""Periodic runs in the words of each text: maximal stretches whose words repeat at a distance.

Word numbers of many texts of similar length are laid side by side, each text closed by a word of
its own. A run of period q and at least `max(shortest, 2q)` words contains two equal words at i and
i + q for some i on a grid of step `max(shortest - q, q)`; the grids of all periods have n log n
places together. Each hit is extended both ways by the longest common extension (LCE) of i and i + q.

An LCE compares a few words first. Any two places have a shift below PERIOD at which both lie on a
difference cover, so a longer extension jumps to two sampled places and reads their common prefix
from a sparse table over the sorted samples. Only the cover's suffixes are sorted, and only where an
extension gets that far. Extensions to the left use the same structure over the reversed words.

Words are compared exactly: they are numbered by a dictionary, not hashed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIOD, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 is one of two elements of the cover
GROUP_WORDS = 1 << 17  # words of texts handled side by side; a longer text is handled alone
CHUNK = 1 << 20  # hits extended at a time
SHORTEST = 12

# _SHIFT[a, b]: the least k for which a + k and b + k are both on the cover, modulo PERIOD
_SHIFT = np.array([[min(k for k in range(PERIOD) if (a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


class Extensions:
    """Longest common extensions to the right of any two places of a sequence of word numbers."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.n = len(numbers)
        # words of its own behind the end, so that no extension passes it
        self.words = np.r_[numbers, np.arange(-2 * PERIOD, 0, dtype=numbers.dtype)]
        self.rank: np.ndarray | None = None

    def _sort(self) -> None:
        """Ranks of the sampled suffixes, in steps of PERIOD words, and a sparse table of neighbours' common blocks."""
        n, words = self.n, np.ascontiguousarray(self.words, dtype=np.int32)
        places = np.concatenate([np.arange(r, n, PERIOD) for r in COVER])
        raw, width, names = words.tobytes(), 4 * PERIOD, defaultdict(count().__next__)
        block = np.fromiter((names[raw[4 * p : 4 * p + width]] for p in places.tolist()), np.int64, len(places)) + 1
        index = np.full(n + PERIOD, -1, np.int64)
        index[places] = np.arange(len(places))
        follower = index[places + PERIOD]  # the number of the sample PERIOD words on, -1 at the end
        # doubling: levels[k] ranks samples by their first 2**k blocks
        levels, jumps = [block], [follower]
        while True:
            rank, jump = levels[-1], jumps[-1]
            both = rank * (len(places) + 2) + np.where(jump >= 0, rank[jump] + 1, 0)
            _, new = np.unique(both, return_inverse=True)
            levels.append(new.astype(np.int64))
            jumps.append(np.where(jump >= 0, jump[jump], -1))
            if new.max(initial=-1) + 1 == len(places):
                break
        self.rank = np.full(n + PERIOD, -1, np.int64)
        self.rank[places] = levels[-1]
        order = np.empty(len(places), np.int64)
        order[levels[-1]] = np.arange(len(places))
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(len(places) - 1, 0), np.int32)
        for k in range(len(levels) - 2, -1, -1):
            same = (a >= 0) & (b >= 0)
            same[same] = levels[k][a[same]] == levels[k][b[same]]
            common[same] += 1 << k
            a[same], b[same] = jumps[k][a[same]], jumps[k][b[same]]
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common blocks of two different samples each: the least value between their ranks."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places `a` on equal those from places `b` on, a < b <= n."""
        length = np.zeros(len(a), np.int64)
        shift = _SHIFT[a % PERIOD, b % PERIOD]
        live = np.arange(len(a))
        for k in range(PERIOD):
            live = live[k < shift[live]]
            live = live[self.words[a[live] + k] == self.words[b[live] + k]]
            length[live] = k + 1
        far = np.flatnonzero(length == shift)
        far = far[b[far] + shift[far] < self.n]
        if not len(far):
            return length
        # two samples: skip the sort where their first words already differ
        x, y = a[far] + length[far], b[far] + length[far]
        same = self.words[x] == self.words[y]
        far, x, y = far[same], x[same], y[same]
        if not len(far):
            return length
        if self.rank is None:
            self._sort()
        skip = self._blocks(x, y) * PERIOD
        length[far] += skip
        live = far
        for _ in range(PERIOD):  # the rest is shorter than a block
            live = live[self.words[a[live] + length[live]] == self.words[b[live] + length[live]]]
            if not len(live):
                break
            length[live] += 1
        return length


def _hits(words: np.ndarray, longest: int, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of equal words at place and place + period on the grid of each period up to `longest`."""
    n = len(words)
    edge = max(shortest, min(longest, isqrt(n)))
    for q in range(1, min(edge, longest) + 1):
        step = max(shortest - q, q)
        at = np.flatnonzero(words[: n - q : step] == words[q::step][: len(range(0, n - q, step))]) * step
        if len(at):
            yield at, np.full(len(at), q)
    # long periods have few places each: take one multiple of every period at a time
    k = 0
    while longest > edge and (k + 1) * (edge + 1) < n:
        last = min(longest, (n - 1) // (k + 1))
        qs = np.arange(edge + 1, last + 1)
        same = words[k * qs] == words[(k + 1) * qs]
        if same.any():
            yield k * qs[same], qs[same]
        k += 1


def _chunks(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += len(p[0])
        if size >= CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def runs(numbers: np.ndarray, longest: int | None = None, shortest: int = SHORTEST) -> np.ndarray:
    """Rows `start, length, period` of all runs of at least `max(shortest, 2 * period)` words, by start, then period.

    Periods up to `longest` are looked for (default: half the sequence).
    """
    n = len(numbers)
    longest = n // 2 if longest is None else min(longest, n // 2)
    right, left, found = Extensions(numbers), Extensions(numbers[::-1]), [np.zeros((0, 3), np.int64)]
    for at, q in _chunks(_hits(numbers, longest, shortest)):
        ahead = right.common(at, at + q)
        back = left.common(n - at - q, n - at)  # of the words before both places; at 0 the second place is the end
        start, length = at - back, back + ahead + q
        good = length >= np.maximum(shortest, 2 * q)
        rows = np.stack([start, length, q], 1)[good]
        found.append(np.unique(rows, axis=0) if len(rows) else rows)
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # a stretch found under several periods has the least one; the others are its multiples
    first = np.r_[True, (every[1:, :2] != every[:-1, :2]).any(1)] if len(every) else np.zeros(0, bool)
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Texts of similar length together, up to GROUP_WORDS words."""
    group, words = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and (words + sizes[i] > GROUP_WORDS or sizes[i] > max(64, 2 * sizes[group[0]])):
            yield group
            group, words = [], 0
        group.append(i)
        words += sizes[i] + 1
    if group:
        yield group


def runs_of_texts(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """`runs` of each text's words."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for group in _groups([len(t) for t in texts]):
        numbers = defaultdict(count().__next__)
        parts, starts, at = [], [], 0
        for g, i in enumerate(group):
            starts.append(at)
            parts.append(np.fromiter(map(numbers.__getitem__, texts[i]), np.int32, len(texts[i])))
            parts.append(np.array([-1000 - g], np.int32))  # the close of a text
            at += len(texts[i]) + 1
        found = runs(np.concatenate(parts), len(texts[group[-1]]) // 2, shortest)
        cuts = np.searchsorted(found[:, 0], [*starts, at])
        for g, i in enumerate(group):
            own = found[cuts[g] : cuts[g + 1]].copy()
            own[:, 0] -= starts[g]
            out[i] = own
    return out


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def find(docs: DataFrame, shortest: int = SHORTEST, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, n_words, runs, collapsed)` of each row: all runs and the text without their repeats.

    Words are stretches of anything but ASCII white space; `runs` holds `(start, length, period)` by
    start, then period, counted in words from 0. A run has at least `max(shortest, 2 * period)` words,
    `period` is its least one, and no neighbouring word extends it. `collapsed` joins the words that no
    run contains after its first period by one space. Null and empty texts have no runs and an empty
    text; rows with a null or repeated id are rows like any other; other columns are left out.
    """
    if shortest < 2:
        raise ValueError("a run has two words at least")

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [(t.as_py() or "").encode().split() for t in batch.column(1)]  # bytes.split() cuts at ASCII white space only
        found = runs_of_texts(words, shortest)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
        offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32))
        kept = pa.array([b" ".join(collapsed(w, f)).decode() for w, f in zip(words, found)], pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, spans), kept],
            names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                yield answer(batch.slice(i, 2000))

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
