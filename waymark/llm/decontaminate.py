"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` writes postings of every token of the corpus: each row of the index is a segment of about
``SEGMENT_WORDS`` words of whole documents with its sorted terms and, per term, the sorted word positions.
``phrase_hits`` slides a window over the test items and intersects, per window, the posting lists shifted by their
offsets, from the term that is rarest in the segment to the most frequent one. ``proximity_hits`` asks for all terms
of an item within a span of words, in any order. Test items go to the tasks in blocks of bounded size; the corpus is
never shuffled, so a frequent term or passage stays spread over all segments.

Defined cases: null or empty texts have no words, hence no hit. Items without words occur nowhere; items shorter than
the window are one window. Item rows with one id are one item; a null id counts as "". Documents are told apart by
row, so repeated rows and repeated or null ids each give a row. Empty tables give empty results. Other columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.scratch import Scratch, join_small
from waymark.llm.words import ALNUM, hashed
from waymark.session import cut_lineage, scratch_dir

SEGMENT_WORDS = 1 << 20
BLOCK_WORDS = 1 << 21
_CANDIDATES = 1 << 21
_INDEX = "segment string, ids array<bigint>, bounds binary, terms binary, firsts binary, postings binary"
_HITS = "segment string, ordinal int, doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def _segment(ids: list, lengths: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([*lengths, np.zeros(0, np.int64)]))]).astype(np.int64)
    order = np.argsort(words, kind="stable").astype(np.uint32)
    terms, firsts = np.unique(words[order], return_index=True)
    row = {"segment": [uuid.uuid4().hex], "ids": pa.array([ids], pa.list_(pa.int64())), "bounds": [bounds.tobytes()],
           "terms": [terms.tobytes()], "firsts": [np.append(firsts, len(words)).astype(np.int64).tobytes()], "postings": [order.tobytes()]}
    return pa.RecordBatch.from_pydict(row)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write the index to ``path``, or below the shared checkpoint folder, and return it."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hashes, n = [], [], [], 0
        for batch in batches:
            all_ids = batch.column(0).to_pylist()
            for words in hashed(batch.column(1), ALNUM):
                ids += all_ids[words.first:words.first + len(words.bounds) - 1]
                lengths.append(np.diff(words.bounds))
                hashes.append(words.hashes)
                n += len(words.hashes)
                if n >= SEGMENT_WORDS:
                    yield _segment(ids, lengths, hashes)
                    ids, lengths, hashes, n = [], [], [], 0
        if ids:
            yield _segment(ids, lengths, hashes)

    path = path or scratch_dir(docs.sparkSession, "postings")
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    rows.mapInArrow(index, _INDEX).write.option("compression", "zstd").option("maxRecordsPerFile", 4).parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


class _Segment:
    """One row of the index with its posting lists as one sorted array of (term, position)."""

    def __init__(self, row: dict):
        self.name, self.ids = row["segment"], row["ids"]
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.firsts = np.frombuffer(row["firsts"], np.int64)
        self.postings = np.frombuffer(row["postings"], np.uint32).astype(np.int64)
        self.n = len(self.postings)
        self.lists = (np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.firsts)) << 32) | self.postings

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The term numbers of hashes, -1 where a term does not occur here."""
        if not len(self.terms):
            return np.full(hashes.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = (term << 32) | position
        return self.lists[np.minimum(np.searchsorted(self.lists, want), self.n - 1)] == want

    def batch(self, marks: np.ndarray, docs: np.ndarray, names: list[str], all_docs: bool) -> pa.RecordBatch:
        """Result rows from the marked words and the (document, item) pairs, sorted by document."""
        inside = np.concatenate([[False], marks, [False]])
        edge = np.zeros(self.n + 1, bool)
        edge[self.bounds] = True
        first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        last = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        doc = np.arange(len(self.ids)) if all_docs else np.unique(docs)
        starts = self.bounds[:-1][doc]
        begin, end = np.searchsorted(first, starts), np.searchsorted(first, self.bounds[1:][doc])
        span_bounds = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        pick = np.repeat(begin - span_bounds[:-1], end - begin) + np.arange(span_bounds[-1])
        origin = np.repeat(starts, end - begin)
        spans = pa.StructArray.from_arrays([pa.array(first[pick] - origin, pa.int64()), pa.array(last[pick] - origin, pa.int64())], ["first", "last"])
        item_bounds = np.append(np.searchsorted(docs, doc), len(docs)).astype(np.int32)
        columns = [pa.array([self.name] * len(doc), pa.string()), pa.array(doc, pa.int32()), pa.array([self.ids[d] for d in doc], pa.int64()),
                   pa.array(np.diff(self.bounds)[doc], pa.int64()), pa.ListArray.from_arrays(pa.array(span_bounds), spans),
                   pa.ListArray.from_arrays(pa.array(item_bounds), pa.array(names, pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "doc_id", "n_words", "spans", "items"])


def _shares(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of about ``limit`` in sum; a single larger entry stands alone."""
    sums, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + limit, side="right")) - 1)
        yield slice(i, j)
        i = j


def _phrases(seg: _Segment, vocabulary: np.ndarray, groups: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked words, and (document, item) of the windows that occur."""
    found = seg.find(vocabulary)
    change, docs, items = np.zeros(seg.n + 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    counts = np.diff(seg.firsts)
    for windows, owner in groups:  # windows of one length, as numbers of the vocabulary
        terms = found[windows]
        keep = (terms >= 0).all(axis=1)
        terms, own, width = terms[keep], owner[keep], windows.shape[1]
        if not len(terms):
            continue
        rarity = np.argsort(counts[terms], axis=1, kind="stable")
        rarest = np.take_along_axis(terms, rarity[:, :1], axis=1)[:, 0]
        for share in _shares(counts[rarest], _CANDIDATES):
            size = counts[rarest[share]]
            window = np.repeat(np.arange(share.start, share.stop), size)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            start = seg.postings[seg.firsts[rarest[window]] + inner] - rarity[window, 0]
            fits = (start >= 0) & (start + width <= seg.n)
            window, start = window[fits], start[fits]
            for k in range(1, width):
                offset = rarity[window, k]
                fits = seg.has(terms[window, offset], start + offset)
                window, start = window[fits], start[fits]
            doc = seg.doc_of(start)
            fits = start + width <= seg.bounds[doc + 1]
            window, start, doc = window[fits], start[fits], doc[fits]
            np.add.at(change, start, 1)
            np.add.at(change, start + width, -1)
            docs.append(doc)
            items.append(own[window])
    return np.cumsum(change[:-1]) > 0, np.concatenate(docs), np.concatenate(items)


def _near(seg: _Segment, vocabulary: np.ndarray, sets: list, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_phrases`` for stretches of at most ``span`` words that hold every term of an item."""
    found, counts = seg.find(vocabulary), np.diff(seg.firsts)
    change, docs, items = np.zeros(seg.n + 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, own in sets:
        terms = found[number]
        if (terms < 0).any():
            continue
        terms = terms[np.argsort(counts[terms], kind="stable")]
        anchor = seg.postings[seg.firsts[terms[0]]:seg.firsts[terms[0] + 1]]
        # A shortest stretch begins with one of the terms: for each anchor, the starts at most span - 1 before it.
        starts = []
        for t in terms:
            own_list = seg.postings[seg.firsts[t]:seg.firsts[t + 1]]
            later = np.searchsorted(anchor, own_list)
            near = later < len(anchor)
            own_list, later = own_list[near], later[near]
            starts.append(own_list[anchor[later] - own_list < span])
        start = np.unique(np.concatenate(starts))
        end = start.copy()
        limit = np.minimum(start + span, seg.bounds[seg.doc_of(start) + 1])
        for t in terms:
            own_list = seg.postings[seg.firsts[t]:seg.firsts[t + 1]]
            at = np.searchsorted(own_list, start)
            following = np.where(at < len(own_list), own_list[np.minimum(at, len(own_list) - 1)], seg.n)
            fits = following < limit
            start, end, limit = start[fits], np.maximum(end, following)[fits], limit[fits]
        np.add.at(change, start, 1)
        np.add.at(change, end + 1, -1)
        docs.append(seg.doc_of(start))
        items.append(np.full(len(start), own))
    return np.cumsum(change[:-1]) > 0, np.concatenate(docs), np.concatenate(items)


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Ids and word hashes of the items, about ``BLOCK_WORDS`` words at a time (a longer item stands alone)."""
    names, words, n = [], [], 0
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("string"))
    for name, body in rows.toLocalIterator():
        own = np.concatenate([w.hashes for w in hashed(pa.array([body], pa.string()), ALNUM)])
        if not len(own):
            continue
        if names and n + len(own) > BLOCK_WORDS:
            yield names, words
            names, words, n = [], [], 0
        names.append(name)
        words.append(own)
        n += len(own)
    yield names, words


def _numbers(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    vocabulary, number = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
    return vocabulary, np.split(number, np.cumsum([len(w) for w in words])[:-1]) if words else []


def _search(index: DataFrame, items: DataFrame, item_id: str, text: str, prepare) -> DataFrame:
    spark, passes = index.sparkSession, []
    for names, words in _item_blocks(items, item_id, text):
        vocabulary, numbers = _numbers(words)
        held = spark.sparkContext.broadcast((names, vocabulary, prepare(numbers)))

        def match(batches: Iterator[pa.RecordBatch], held=held, all_docs=not passes) -> Iterator[pa.RecordBatch]:
            own_names, own_vocabulary, (find, asked) = held.value
            for batch in batches:
                for i in range(batch.num_rows):
                    seg = _Segment(batch.slice(i, 1).to_pylist()[0])
                    marks, docs, owner = find(seg, own_vocabulary, *asked)
                    pairs = sorted({(d, own_names[o]) for d, o in set(zip(docs.tolist(), owner.tolist(), strict=True))})
                    yield seg.batch(marks, np.array([d for d, _ in pairs], np.int64), [o for _, o in pairs], all_docs)

        path = scratch_dir(spark, "hits")
        index.mapInArrow(match, _HITS).write.parquet(path)
        held.destroy()
        passes.append(path)
    hits = spark.read.schema(_HITS).parquet(*passes)
    if len(passes) > 1:
        hits = hits.groupBy("segment", "ordinal").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans of different blocks may overlap: count each word once.
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["last"]).alias("end"),
                                   (acc["n"] + F.greatest(x["last"] - F.greatest(acc["end"], x["first"]), F.lit(0))).alias("n"))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    return hits.select("doc_id", "n_words", F.aggregate("spans", zero, step)["n"].alias("n_hit"), "spans", "items", "segment", "ordinal")


def phrase_hits(index: DataFrame, items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, spans`` (hit word ranges), ``items``, ``segment, ordinal``."""
    def prepare(numbers: list[np.ndarray]):
        by_width: dict[int, list] = {}
        for i, number in enumerate(numbers):
            width = min(window, len(number))
            slid = np.lib.stride_tricks.sliding_window_view(number, width)
            by_width.setdefault(width, []).append((slid, np.full(len(slid), i)))
        return _phrases, ([(np.concatenate([s for s, _ in g]), np.concatenate([o for _, o in g])) for g in by_width.values()],)

    return _search(index, items, item_id, text, prepare)


def proximity_hits(index: DataFrame, items: DataFrame, span: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """As ``phrase_hits``, for all distinct words of an item within ``span`` words in any order."""
    return _search(index, items, item_id, text, lambda numbers: (_near, ([(np.unique(w), i) for i, w in enumerate(numbers)], span)))


def report(hits: DataFrame) -> DataFrame:
    """The digest columns of ``phrase_hits``."""
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_hits(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item.

    A row is named by a hash of its id and text, so rows that share an id are judged one by one.
    """
    key, scratch = F.xxhash64(F.col(doc_id), F.col(text)), Scratch(docs.sparkSession)
    index = build_index(docs.select(key.alias("row"), F.col(text).alias("body")), "row", "body", scratch.path())
    bad = cut_lineage(phrase_hits(index, items, window).filter("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct())
    scratch.clear()
    return join_small(docs, bad, key == bad["_bad"], "left_anti")
