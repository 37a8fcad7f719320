"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids and one end id are cut into pieces of the sequence length and a rest. Pieces are dealt to groups by a
seeded draw per row; a group holds about ``GROUP_SEQUENCES`` full sequences, however large the input is. Spark sorts a
group's pieces by falling length, and a task walks through them once: a tournament tree over the free room of the open
sequences finds the first one that a piece fits in, else a new sequence begins. The task keeps the tree, not the ids.
Only the last sequences of a group have room left, so the padding falls with the size of the groups.

Sequences are padded to the sequence length; one that holds a power of two of ids is a batch shape of its own and is not.

Defined cases: null and empty texts have the end id alone. Repeated rows and rows of one or no id are documents each.
A text of any length is cut whole; its full pieces are dealt to groups one by one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import Scratch
from waymark.llm.tokens import text_ids

SEQUENCE = 4096
GROUP_SEQUENCES = 1024
_PIECES = "doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary"
_PACKED = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"


class FirstFit:
    """Free room of the sequences in order, under a tournament of the largest: the first with enough room wins."""

    def __init__(self):
        self.leaves, self.n = 1, 0
        self.room = [0, 0]

    def _grow(self) -> None:
        old, leaves = self.room[self.leaves:], self.leaves * 2
        self.room = [0] * leaves + old + [0] * self.leaves
        for i in range(leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        self.leaves = leaves

    def _set(self, n: int, room: int) -> None:
        i = self.leaves + n
        self.room[i] = room
        while i > 1:
            i >>= 1
            best = max(self.room[2 * i], self.room[2 * i + 1])
            if self.room[i] == best:
                break
            self.room[i] = best

    def put(self, size: int, capacity: int) -> tuple[int, int]:
        """The number of the sequence that takes ``size`` more ids, and how many it held."""
        room = self.room
        if size > room[1]:
            if self.n == self.leaves:
                self._grow()
            self.n += 1
            self._set(self.n - 1, capacity - size)
            return self.n - 1, 0
        i = 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        free = room[i]
        self._set(i - self.leaves, free - size)
        return i - self.leaves, capacity - free


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = SEQUENCE) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: pieces of every document; ids are little-endian unsigned 32-bit."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), text_ids(batch.column(1), tokenizer), strict=True):
                total = len(ids) + 1
                whole = np.append(ids, np.int32(end_id)).astype("<u4")
                for start in range(0, total, length):
                    part = whole[start:start + length]
                    rows.append((doc_id, start, len(part), total, part.tobytes()))
                    size += len(part)
                    if size > 1 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = SEQUENCE, group_sequences: int = GROUP_SEQUENCES, seed: int = 12) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, sequence_id, offset``: every piece and its place in a sequence."""
    step = Scratch(docs.sparkSession)
    # The row's place is in the draw, so that rows of one id do not share a group; once written it stays.
    pieces = step.cut(cut_pieces(docs, tokenizer, end_id, length).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id())))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (length * group_sequences)))
    dealt = pieces.withColumn("pack_group", F.pmod("draw", F.lit(groups)))
    tasks = -(-groups // 2)  # the number of groups follows the data, so a task stays at some two groups

    def first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree = None, FirstFit()
        for batch in batches:
            sequence, offset = [], []
            for group, size in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if group != current:
                    current, tree = group, FirstFit()
                n, at = tree.put(size, length)
                sequence.append((group << 32) + n)
                offset.append(at)
            columns = batch.columns[1:]
            columns[2] = columns[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    in_order = dealt.repartition(tasks, "pack_group").sortWithinPartitions("pack_group", F.col("length").desc(), "draw")
    return in_order.select("pack_group", "doc_id", "start", "length", "doc_tokens", "ids").mapInArrow(first_fit, _PACKED)


def sequences(packed: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``sequence_id, ids, used, padded_to``: the ids of every sequence in a row, without the padding."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"), F.sum("length").alias("used"))
    power = F.expr("used & (used - 1)") == 0
    joined = F.expr("aggregate(held, CAST('' AS BINARY), (done, h) -> concat(done, h.ids))")
    return held.select("sequence_id", joined.alias("ids"), "used", F.when(power, F.col("used")).otherwise(F.lit(length)).cast("bigint").alias("padded_to"))
