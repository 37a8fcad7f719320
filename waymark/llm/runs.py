"""Periodic runs of words by online dyadic square catching.

Words are appended stretch by stretch. Level ``k`` keeps the name of the last ``B = 2**k`` words at every position, made
of two names of the level below. Whenever an aligned block of ``B`` words is complete, a catcher is armed for it: it
waits for its name to come back at the distances of its level, so every appended word is compared with the blocks that
still wait. A repeat of ``exponent`` periods ``q`` holds a stretch of ``(exponent - 1) * q`` words that equal the word
``q`` further on, and a level takes the periods for which such a stretch must hold one of its aligned blocks. A caught
block is a guess by name; comparing words to both sides of it, and on through later stretches while it reaches the end,
gives the maximal stretch, and squares at one distance thereby merge into one run. A block that lies inside of a run of a
smaller period all the way to its copy can only repeat that run and is left out.

Texts of an Arrow batch are one stream in which a word that never repeats parts neighbouring texts, so short texts cost
no extra steps and no run crosses a text. Words are told apart by their own bytes. Memory grows with the batch, or with one
text if that is longer. There is no shuffle.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text. Rows stay as they are, repeated or
of no id; ``find_runs`` keeps the columns it is given and reads no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.words import SPACED, flat, mixed, spans

APPEND = 1 << 18  # words appended at a time
_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class _Level:
    """Names of the last words that a level still needs, from position ``base`` on."""

    def __init__(self, size: int, exponent: int):
        self.size = size
        self.lowest = -(-(2 * size - 1) // (exponent - 1))
        self.highest = -(-(4 * size - 1) // (exponent - 1)) - 1
        self.base, self.names = 0, np.zeros(0, np.uint64)

    def grow(self, new: np.ndarray, end: int) -> None:
        """Take the names of appended words; forget those that no block still waits for and no name is still made of."""
        tail = max(0, end - max(2 * self.size, self.size + self.highest) - 1)
        kept = self.names[max(0, tail - self.base):]
        self.base += len(self.names) - len(kept)
        self.names = np.concatenate([kept, new])

    def part(self, first: int, behind: int, step: int = 1) -> np.ndarray:
        return self.names[first - self.base:behind - self.base:step]


class _Covers:
    """How far runs of small periods go on from a position."""

    def __init__(self, runs: list[tuple[int, int]]):
        runs.sort()
        self.starts = np.array([s for s, _ in runs], np.int64)
        self.ends = np.maximum.accumulate(np.array([-1] + [e for _, e in runs], np.int64))

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.starts, at, side="right")]


class SquareCatcher:
    """Runs of at least ``exponent`` periods in a stream of word numbers: ``append`` words, then ask ``runs``.

    No run is longer than ``longest``, which ends the levels.
    """

    def __init__(self, exponent: int = 4, longest: int = 1 << 62):
        self.exponent, self.largest = exponent, longest // exponent
        self.buffer, self.end = np.zeros(1024, np.int64), 0
        self.levels: list[_Level] = []
        self.open: dict[int, int] = {}  # period: start of a stretch that reaches the end
        self.met: dict[int, int] = {}  # period: end of its last stretch
        self.caught: list[tuple[int, int, int]] = []  # start, end, period

    def append(self, words: np.ndarray) -> None:
        before, self.end = self.end, self.end + len(words)
        if self.end > len(self.buffer):
            self.buffer = np.concatenate([self.buffer[:before], np.zeros(2 * self.end - before, np.int64)])
        self.buffer[before:self.end] = words
        for period, start in list(self.open.items()):
            self._close(start, self._right(before - period, period), period)
        k, size = 0, 1
        while size <= self.end:
            if k == len(self.levels):
                self.levels.append(_Level(size, self.exponent))
            level = self.levels[k]
            if level.lowest > self.largest:
                break
            first = max(0, before - size + 1)
            if k:
                below = self.levels[k - 1]
                left, right = below.part(first, self.end - size + 1), below.part(first + size // 2, self.end - size // 2 + 1)
                new = mixed(left * np.uint64(3) + right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
            else:
                new = mixed(self.buffer[first:self.end].astype(np.uint64))
            level.grow(new, before)
            self._catch(level, before)
            k, size = k + 1, size * 2

    def _catch(self, level: _Level, before: int) -> None:
        """Compare the appended words with the blocks that wait, and follow those that come back."""
        size, low, high = level.size, level.lowest, min(level.highest, self.largest)
        if low > high:
            return
        covers = _Covers([(s, e) for s, e, q in self.caught if q < low and q <= size] + [(s, self.end) for q, s in self.open.items() if q < low and q <= size])
        # a copy that ends with an appended word starts at before - size + 1 or later, its block a period before it
        first = -(-max(0, before - size + 1 - high) // size) * size
        n_blocks = max(0, -(-(self.end - size - low + 1 - first) // size))
        if n_blocks > high - low:
            for period in range(low, high + 1):
                start = -(-max(0, before - size + 1 - period) // size) * size
                copies = level.part(start + period, self.end - size + 1, size)
                blocks = start + size * np.flatnonzero(level.part(start, start + len(copies) * size, size)[:len(copies)] == copies)
                blocks = blocks[covers(blocks) < blocks + period + size]
                i = 0
                while i < len(blocks):
                    self._follow(int(blocks[i]), period)
                    i = max(i + 1, int(np.searchsorted(blocks, self.met.get(period, 0))))
        else:
            for block in range(first, first + n_blocks * size, size):
                start = max(low, before - size + 1 - block, int(covers(np.array([block]))[0]) - block - size + 1)
                stop = min(high, self.end - size - block)
                if start <= stop:
                    for i in np.flatnonzero(level.part(block + start, block + stop + 1) == level.part(block, block + 1)):
                        self._follow(block, start + int(i))

    def _follow(self, block: int, period: int) -> None:
        """The whole stretch around a block whose words equal those a period further on."""
        if block < self.met.get(period, 0) or period in self.open:
            return
        self._close(self._left(block, period), self._right(block, period), period)

    def _close(self, start: int, stop: int, period: int) -> None:
        self.met[period] = stop
        if stop + period == self.end:
            self.open[period] = start
            return
        self.open.pop(period, None)
        if stop - start >= (self.exponent - 1) * period:
            self.caught.append((start, stop + period, period))

    def _right(self, at: int, period: int) -> int:
        step, words = 64, self.buffer
        while at < self.end - period:
            stop = min(at + step, self.end - period)
            other = np.flatnonzero(words[at:stop] != words[at + period:stop + period])
            if len(other):
                return at + int(other[0])
            at, step = stop, step * 2
        return at

    def _left(self, at: int, period: int) -> int:
        step, words = 64, self.buffer
        while at > 0:
            start = max(0, at - step)
            other = np.flatnonzero(words[start:at] != words[start + period:at + period])
            if len(other):
                return start + int(other[-1]) + 1
            at, step = start, step * 2
        return at

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period) of all runs so far, by start and period."""
        found = self.caught + [(s, self.end, q) for q, s in self.open.items() if self.end - s >= self.exponent * q]
        smallest: dict[tuple[int, int], int] = {}
        for start, end, period in found:
            smallest[start, end] = min(period, smallest.get((start, end), period))
        return sorted((s, e, q) for (s, e), q in smallest.items())


def batch_runs(texts: pa.Array, exponent: int, shortest: int) -> tuple[pa.Array, pa.Array]:
    """The runs of every text, and its words without the repeats of its runs."""
    data, bounds = flat(texts)
    start, end = spans(data, bounds, SPACED)
    inside = SPACED[data]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())]).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int64)
    firsts = np.searchsorted(start, bounds)  # of the texts' words
    n = len(bounds) - 1
    # Word i of text t stands at i + t of the stream: a number of its own stands behind each text.
    stream = np.empty(len(ids) + n, np.int64)
    ends = firsts[1:] + np.arange(n)
    plain = np.ones(len(stream), bool)
    plain[ends] = False
    stream[plain], stream[ends] = ids, len(words.dictionary) + np.arange(n)
    catcher = SquareCatcher(exponent, int(np.diff(firsts).max(initial=0)))
    for i in range(0, len(stream), APPEND):
        catcher.append(stream[i:i + APPEND])
    found = np.array([(s, e - s, q) for s, e, q in catcher.runs() if e - s >= shortest], np.int64).reshape(-1, 3)
    text = np.searchsorted(ends, found[:, 0])
    depth = np.zeros(len(stream) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    kept = (np.cumsum(depth[:-1]) == 0)[plain]
    left = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[firsts]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words.dictionary.take(pa.array(ids[kept]))), pa.scalar(" ", pa.large_string()))
    own = found[:, 0] - (np.concatenate([[0], ends + 1])[text] if n else 0)
    struct = pa.StructArray.from_arrays([pa.array(own), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), struct)
    return runs, collapsed.cast(pa.string())


def find_runs(docs: DataFrame, *kept: Column, exponent: int = 4, shortest: int = 6) -> DataFrame:
    """The ``kept`` columns, ``runs`` (start, length, period by start and period) and ``collapsed`` of every row's text."""
    rows = docs.select(F.col("text").cast("string").alias("_text"), *kept)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = batch_runs(batch.column(0), exponent, shortest)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], runs, collapsed], schema.names)

    return rows.mapInArrow(detect, schema)
