"""Ranked lexical search, half term at a time and half document at a time.

The index holds every document once, in segments of one Arrow batch: the terms by their own bytes, for each its documents
in order of id with the number of occurrences, and the sizes of the documents. A query's terms are split by the length of
their lists in a segment. Short lists are walked term at a time into one list of summed accumulators. That list and the
long ones are then walked document at a time over blocks of ``BLOCK`` documents: a block's bound is the largest sum in
it plus, for each long list, the score of the best occurrence in it, and a block whose bound is below the score of the
k-th best document so far is skipped in all lists. Bounds are exact integers, so no document is lost.

Document frequencies of the queries' terms are summed over the segments before. Queries are written to the shared folder
and every task streams over them for its segments. A task keeps k documents of a query and segment; Spark ranks those.

Defined cases: null texts and texts without terms are not in the index. A null id ranks behind all ids of its score.
Repeated rows are documents each, repeated queries are answered each. A query without terms or matches has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.scratch import Scratch, join_small
from waymark.llm.words import ALNUM, LOWER, flat, spans

BLOCK = 64
QUERY_BATCH = 256
SHORT = 32  # a list is short if it holds at most one in 32 documents of the segment
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEGMENT = "n_docs bigint, n_terms bigint, doc_ids array<bigint>, sizes binary, terms array<string>, dfs array<int>, docs binary, counts binary"


def segment_of(doc_ids: pa.Array, texts: pa.Array) -> list | None:
    """The columns of one segment."""
    order = pc.sort_indices(doc_ids, null_placement="at_end").to_numpy()
    data, bounds = flat(texts)
    start, end = spans(data, bounds, ALNUM)
    inside = ALNUM[data]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]].tobytes())]).dictionary_encode()
    sizes = np.diff(np.searchsorted(start, bounds))
    kept = order[sizes[order] > 0]  # documents by id
    if not len(kept):
        return None
    place = np.empty(len(sizes), np.int64)
    place[kept] = np.arange(len(kept))
    keys, counts = np.unique(words.indices.to_numpy().astype(np.int64) * len(kept) + np.repeat(place, sizes), return_counts=True)
    term, doc = np.divmod(keys, len(kept))
    dfs = np.bincount(term, minlength=len(words.dictionary))
    return [len(kept), int(sizes.sum()), doc_ids.take(pa.array(kept)), sizes[kept].astype("<i8").tobytes(), words.dictionary.cast(pa.string()), dfs, doc.astype("<i4").tobytes(),
            counts.astype("<i4").tobytes()]


def build_index(docs: DataFrame, step: Scratch) -> DataFrame:
    """Write the segments of ``doc_id, text``."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["n_docs", "n_terms", "doc_ids", "sizes", "terms", "dfs", "docs", "counts"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (columns := segment_of(batch.column(0), batch.column(1))):
                yield pa.RecordBatch.from_arrays([_one(c, t) for c, t in zip(columns, types, strict=True)], names)

    return step.cut(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(segments, _SEGMENT))


def _one(value, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    values = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Segment:
    """A segment's lists with the score of each occurrence, as far as queries have asked for them."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.ids, self.terms = column("doc_ids")[0].values, column("terms")[0].values
        self.docs, self.counts = (np.frombuffer(column(c)[0].as_py(), "<i4") for c in ("docs", "counts"))
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(column("dfs")[0].values.to_numpy(), dtype=np.int64)])
        sizes = np.frombuffer(column("sizes")[0].as_py(), "<i8")
        if int(sizes.max()) * 25 * n_docs < 1 << 63:
            self.weight = 75 + 25 * sizes * n_docs // n_terms
        else:
            self.weight = np.array([75 + 25 * int(n) * n_docs // n_terms for n in sizes], np.int64)
        self.n = len(sizes)
        self.n_blocks = -(-self.n // BLOCK)
        self.lists: dict[int, tuple] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        docs = self.docs[self.bounds[term]:self.bounds[term + 1]]
        tf = self.counts[self.bounds[term]:self.bounds[term + 1]].astype(np.int64)
        return docs, 1_000_000_000 * tf // (1000 * tf + 12 * self.weight[docs])

    def long_list(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, scores, where each block begins in them, and each block's best score."""
        if term not in self.lists:
            docs, scores = self.postings(term)
            at = np.searchsorted(docs, np.arange(self.n_blocks + 1) * BLOCK)
            best = np.zeros(self.n_blocks, np.int64)
            full = at[1:] > at[:-1]
            best[full] = np.maximum.reduceat(scores, at[:-1][full])
            self.lists[term] = docs, scores, at, best
        return self.lists[term]

    def best(self, terms: np.ndarray, factors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (places in the segment) and their scores, best first."""
        lengths = self.bounds[terms + 1] - self.bounds[terms]
        short = lengths * SHORT <= self.n
        lists = [(self.long_list(t), f) for t, f in zip(terms[~short].tolist(), factors[~short].tolist(), strict=True)]
        bound = np.zeros(self.n_blocks, np.int64)
        for (_, _, _, best), factor in lists:
            bound += factor * best
        level = 1
        if short.any():
            walked = [self.postings(t) for t in terms[short].tolist()]
            docs = np.concatenate([d for d, _ in walked])
            scores = np.concatenate([s * f for (_, s), f in zip(walked, factors[short].tolist(), strict=True)])
            order = np.argsort(docs, kind="stable")
            docs, first = np.unique(docs[order], return_index=True)
            sums = np.add.reduceat(scores[order], first)
            at = np.searchsorted(docs, np.arange(self.n_blocks + 1) * BLOCK)
            full = at[1:] > at[:-1]
            best = np.zeros(self.n_blocks, np.int64)
            best[full] = np.maximum.reduceat(sums, at[:-1][full])
            bound += best
            lists.append(((docs, sums, at, best), 1))
            if len(sums) >= k:
                level = max(1, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the best blocks first raise the level; then all others in the order of the documents
        ahead = np.argsort(-bound, kind="stable")[:8]
        waiting = np.ones(self.n_blocks, bool)
        waiting[ahead] = False
        blocks, behind, width = np.sort(ahead), np.flatnonzero(waiting), 8
        while True:
            blocks = blocks[bound[blocks] >= level]
            if len(blocks):
                docs, scores = self._score(blocks, lists, level)
                found, score = np.concatenate([found, docs]), np.concatenate([score, scores])
                if len(found) > k:
                    top = np.lexsort((found, -score))[:k]
                    found, score = found[top], score[top]
                if len(found) == k:
                    level = max(level, int(score.min()))
            behind = behind[bound[behind] >= level]
            if not len(behind):
                break
            blocks, behind, width = behind[:width], behind[width:], width * 2
        top = np.lexsort((found, -score))
        return found[top], score[top]

    @staticmethod
    def _score(blocks: np.ndarray, lists: list, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Full scores of the documents of some blocks that reach the level."""
        total = np.zeros(len(blocks) * BLOCK, np.int64)
        for (docs, scores, at, _), factor in lists:
            counts = at[blocks + 1] - at[blocks]
            behind = np.cumsum(counts)
            here = np.arange(int(behind[-1])) + np.repeat(at[blocks] - behind + counts, counts)
            total[np.repeat(np.arange(len(blocks)) * BLOCK, counts) + docs[here] % BLOCK] += factor * scores[here]
        good = np.flatnonzero(total >= level)
        return blocks[good // BLOCK] * BLOCK + good % BLOCK, total[good]


def search(index: DataFrame, queries: DataFrame, step: Scratch, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every query row."""
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    numbered = queries.select(F.monotonically_increasing_id().alias("query_row"), F.col(item_id).alias("item_id"), lowered.alias("lowered"))
    words = numbered.select("query_row", "item_id", F.explode(F.regexp_extract_all("lowered", F.lit(_TERM), F.lit(0))).alias("term"))
    asked = step.cut(words.groupBy("query_row", "item_id", "term").agg(F.count("*").alias("repeats")))
    in_segments = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("of")).select(F.col("of.terms").alias("term"), F.col("of.dfs").alias("df"))
    known = asked.select("term").distinct().withColumnRenamed("term", "wanted")
    dfs = step.cut(join_small(in_segments, step.cut(known), F.col("term") == F.col("wanted"), "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    factor = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))) * F.col("repeats")
    weighed = asked.join(dfs, "term").select("query_row", "item_id", "term", factor.cast("bigint").alias("factor")).filter("factor > 0")
    rows = weighed.groupBy("query_row", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", "factor"))).alias("of"))
    path = step.path()
    rows.select("query_row", "item_id", F.col("of.term").alias("terms"), F.col("of.factor").alias("factors")).write.parquet(path)
    files, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    names = sorted(f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
    kind = queries.schema[item_id].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1), n_docs, n_terms)
                for name in names:
                    with files.open_input_file(name) as source:
                        for some in pq.ParquetFile(source).iter_batches(QUERY_BATCH):
                            if answer := _answers(segment, some, k):
                                yield answer

    best = index.drop("n_docs", "n_terms").mapInArrow(found, f"query_row bigint, item_id {kind}, doc_id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _answers(segment: Segment, queries: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
    lists, factors = queries.column(2), queries.column(3).flatten().to_numpy()
    place = pc.index_in(lists.flatten().cast(segment.terms.type), value_set=segment.terms)
    met, place = pc.is_valid(place).to_numpy(zero_copy_only=False), pc.fill_null(place, 0).to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    segment.lists.clear()
    rows, docs, scores = [], [], []
    for row in range(queries.num_rows):
        here = slice(bounds[row], bounds[row + 1])
        if met[here].any():
            found, score = segment.best(place[here][met[here]], factors[here][met[here]], k)
            rows.append(np.full(len(found), row))
            docs.append(found)
            scores.append(score)
    if not rows:
        return None
    rows = pa.array(np.concatenate(rows))
    return pa.RecordBatch.from_arrays([queries.column(0).take(rows), queries.column(1).take(rows), segment.ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))],
                                      ["query_row", "item_id", "doc_id", "score"])
