"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. Texts with one set are one class of copies and take part once. Each class
keeps ``COORDINATES`` min-hashes: tokens that two sets share with a probability equal to their Jaccard similarity. A run
starts with all classes in one node; a node samples two of the coordinates by its own hash and sends each class to the
two children named by the class's tokens there, so sets split on sampled shared tokens. Nodes of one class are dropped,
nodes of up to ``LEAF`` classes are done, and so are dense ones, where a sampled token is common to most classes: there
splitting would only copy the node. Two sets of similarity s part at both children with probability (1 - s)^2 and more
deeply with at most the fixed point of x = (1 - s + s x)^2, 1/16 for s = 0.8; runs are repeated until the target recall.

In the leaves every pair is looked at once: at the first leaf the two share, which bit masks of the earlier common
leaves tell. Min-hash agreement rules out the clearly different, the others are compared by their whole shingle sets.
Leaves of more than ``CHUNK`` classes are cut into chunks, and each pair of chunks is a task of its own. Tasks give
sums of links and spanning links, never the pairs.

Defined cases: a text of one to four words is one shingle of all its words; null, empty and wordless texts are alone,
without links. Repeated rows are copies. The class id is the smallest id of the connected class, null if it has none.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import Scratch, join_small
from waymark.llm.words import ALNUM, hashed, mixed
from waymark.operators.clusters import components
from waymark.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
COORDINATES = 64
LEAF = 128
CHUNK = 512
_DENSE = 0.7
_DEPTH = 24
_ROWS = 20_000

_odd = lambda n, start: mixed(np.arange(start, start + n, dtype=np.uint64)) | np.uint64(1)
_PLACE = _odd(SHINGLE, 1)
_FACTOR, _SHIFT = _odd(COORDINATES, 101), mixed(np.arange(201, 201 + COORDINATES, dtype=np.uint64))
_SKETCHES = f"row_key bigint, doc_id bigint, set_key string, n_shingles int, tokens array<int>, sketch binary"


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for words in hashed(column, ALNUM):
        h = words.hashes
        wide = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            wide += h[k:len(h) - SHINGLE + 1 + k] * _PLACE[k] if len(wide) else 0
        wide = mixed(wide)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(wide[a:b - SHINGLE + 1])
            else:
                yield mixed(np.array([(h[a:b] * _PLACE[:b - a]).sum() + np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> str:
    """A 128-bit name of a set."""
    return f"{int(mixed(shingles).sum()):016x}{int(mixed(shingles * _PLACE[1]).sum()):016x}"


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[None, i:i + 4096] * _FACTOR[:, None]
        part += _SHIFT[:, None]
        out = np.minimum(out, part.min(axis=1) >> np.uint64(32))
    return out.astype(np.uint32)


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its set's name and min-hashes."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, tokens = [], [], []
            for shingles in shingle_sets(batch.column(2)):
                keys.append(set_key(shingles) if len(shingles) else None)
                sizes.append(len(shingles))
                tokens.append(min_hashes(shingles))
            flat = np.concatenate([*tokens, np.zeros(0, np.uint32)])
            bounds = np.arange(len(keys) + 1, dtype=np.int32) * COORDINATES
            low = pa.array([t.astype(np.uint8).tobytes() for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int32))), low], [f.split()[0] for f in _SKETCHES.split(", ")])

    rows = docs.select(row_key(doc_id, text).alias("row_key"), F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(sketch, _SKETCHES)


def _sampled(node: Column, tokens: Column) -> Column:
    """The two children of a node for a class."""
    one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDINATES)).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
    return F.explode(F.array(*[F.xxhash64(node, c, F.get(tokens, c)) for c in (one, two)]))


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair of that similarity has met with probability ``recall``, for paths of any length."""
    missed = 0.0
    for _ in range(1000):
        missed = (1 - similarity + similarity * missed) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed))) if 0 < missed < 1 else 1


def path_leaves(classes: DataFrame, runs: int, scratch: Scratch) -> DataFrame:
    """``leaf, n, set_key``: the leaves in which classes meet; a class comes to a node from one parent only."""
    roots = F.explode(F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in range(runs)]))
    rows = classes.select("set_key", "tokens", roots.alias("parent")).withColumn("parent_n", F.lit(2 ** 62))
    leaves = []
    for depth in range(1, _DEPTH + 1):
        members = scratch.cut(rows.select("set_key", "parent_n", _sampled(F.col("parent"), F.col("tokens")).alias("node")))
        counts = members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        met = scratch.cut(members.join(counts, "node"))
        done = (F.col("n") <= LEAF) | (F.col("n") >= _DENSE * F.col("parent_n")) | F.lit(depth == _DEPTH)
        leaves.append(met.filter(done).select(F.col("node").alias("leaf"), "n", "set_key"))
        rows = met.filter(~done).select("set_key", F.col("node").alias("parent"), F.col("n").alias("parent_n"))
        if rows.isEmpty():
            break
        rows = rows.join(classes.select("set_key", "tokens"), "set_key")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _tasks(leaves: DataFrame) -> DataFrame:
    """``task, side, set_key, leaf``: the members of each pair of chunks of a leaf; side 2 is a leaf of one chunk."""
    chunks = F.ceil(F.col("n") / CHUNK)
    rows = leaves.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("set_key"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return rows.select(F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")).alias("task"), side.alias("side"), "set_key", "leaf")


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole tasks (column 0) from batches that are sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        task = table.column(0).to_numpy()
        cut = int(np.searchsorted(task, task[-1]))  # the last task may go on
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(task: np.ndarray, side: np.ndarray, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one task that meet here first; of two chunks only pairs across."""
    end = np.searchsorted(task, task, side="right")
    i, d = np.arange(len(task)), 1
    while len(i := i[i + d < end[i]]):
        j = i + d
        fits = ((side[i] == 2) | (side[i] != side[j])) & ~(masks[i] & masks[j]).any(axis=1)
        if fits.any():
            yield i[fits], j[fits]
        d += 1


def _masks(task: np.ndarray, leaf: np.ndarray, leaves: pa.Array) -> np.ndarray:
    """Per row, bits of the leaves before this one that it shares with others of its task."""
    lists = leaves.combine_chunks() if isinstance(leaves, pa.ChunkedArray) else leaves
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(task)), lengths)
    value = lists.flatten().to_numpy()
    early = value < leaf[row]
    row, value = row[early], value[early]
    order = np.lexsort((value, task[row]))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (task[row][1:] != task[row][:-1]) | (value[1:] != value[:-1])
    group = np.cumsum(fresh) - 1
    shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    row, value, group = row[shared], value[shared], group[shared]
    if not len(row):
        return np.zeros((len(task), 1), np.uint64)
    _, dense = np.unique(group, return_inverse=True)
    first = np.ones(len(row), bool)
    first[1:] = task[row][1:] != task[row][:-1]
    bit = dense - dense[np.flatnonzero(first)][np.cumsum(first) - 1]
    masks = np.zeros((len(task), int(bit.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(masks, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return masks


def plausible_members(classes: DataFrame, leaves: DataFrame, similarity: float) -> DataFrame:
    """``task, side, masks, set_key`` of the classes with a partner that min-hashes do not rule out, at their first leaf."""
    least = similarity * COORDINATES - 4.75 * math.sqrt(COORDINATES * similarity * (1 - similarity))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, _ROWS):
            task, side, leaf = (table.column(c).to_numpy() for c in range(3))
            sketch = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(len(task), COORDINATES)
            masks = _masks(task, leaf, table.column(5))
            keep = np.zeros(len(task), bool)
            for i, j in _pairs(task, side, masks):
                near = (sketch[i] == sketch[j]).sum(axis=1) >= least
                keep[i[near]] = keep[j[near]] = True
            row = np.flatnonzero(keep)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * masks.shape[1]), pa.array(masks[row].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(task[row]), pa.array(side[row]), bits, table.column(3).combine_chunks().take(pa.array(row))],
                                             ["task", "side", "masks", "set_key"])

    own = leaves.groupBy("set_key").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))  # as many as runs and depth allow
    known = classes.select("set_key", "sketch").join(own, "set_key")
    rows = _tasks(leaves).join(known, "set_key").select("task", "side", "leaf", "set_key", "sketch", "leaves")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(prune, "task bigint, side int, masks array<bigint>, set_key string")


def exact_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``set_key, links, root``: per task, the documents a class is linked to and a class it is connected to.

    ``texts`` has ``set_key, copies, text``; rows whose text has another set are left out.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, CHUNK):
            tasks, keys = table.column(0).to_numpy(), table.column(3).to_pylist()
            chosen, sets, seen = [], [], set()
            for n, shingles in enumerate(shingle_sets(table.column(5))):
                if (tasks[n], keys[n]) not in seen and len(shingles) and set_key(shingles) == keys[n]:
                    seen.add((tasks[n], keys[n]))
                    chosen.append(n)
                    sets.append(shingles)
            side, copies = table.column(1).to_numpy()[chosen], table.column(4).to_numpy()[chosen]
            lists = [np.array(m, np.int64).view(np.uint64) for m in table.column(2).take(pa.array(chosen, pa.int64())).to_pylist()]
            keys = [keys[n] for n in chosen]
            begin = 0
            for stop in [*(np.flatnonzero(np.diff(tasks[chosen])) + 1).tolist(), len(chosen)]:
                if stop - begin > 1:
                    part = slice(begin, stop)
                    width = max(map(len, lists[part]))
                    masks = np.array([np.pad(m, (0, width - len(m))) for m in lists[part]])
                    links, roots = _linked(sets[part], side[part], masks, copies[part], similarity)
                    hit = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[begin + n] for n in hit], pa.string()), pa.array(links[hit]),
                                                      pa.array([keys[begin + roots[n]] for n in hit], pa.string())], ["set_key", "links", "root"])
                begin = stop

    rows = members.join(texts, "set_key").select("task", "side", "masks", "set_key", "copies", "text")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "set_key string, links bigint, root string")


def _linked(sets: list[np.ndarray], side: np.ndarray, masks: np.ndarray, copies: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents per class of one task, and the first class of each one's connected part."""
    size = np.array([len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    common = often[column] > 1
    _, column = np.unique(column[common], return_inverse=True)
    bits = np.zeros((len(sets), int(column.max()) // 64 + 1 if len(column) else 1), np.uint64)
    np.bitwise_or.at(bits, (row[common], column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[((side[j] == 2) | (side[j] != side[i])) & ~(masks[j] & masks[i]).any(axis=1)]
        both = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
        j = j[both >= similarity * (size[j] + size[i] - both) - 1e-9]
        if len(j):
            links[i] += copies[j].sum()
            links[j] += copies[i]
            old = np.unique(root[np.append(j, i)])
            root[np.isin(root, old)] = old[0]
    return links, root


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_key, doc_id, set_key, n_shingles, class_id, n_links`` of every document; its copies count as links."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.cut(sketches(docs, doc_id, text))
    classes = sketched.filter("set_key is not null").groupBy("set_key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"),
        F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))  # one set has one sketch
    classes = scratch.cut(classes)
    leaves = scratch.cut(path_leaves(classes, runs_for(recall, similarity), scratch))
    members = scratch.cut(plausible_members(classes, leaves, similarity))
    wanted = members.select("set_key").distinct().join(classes.select("set_key", "copies", F.col("row_key").alias("wanted")), "set_key")
    bodies = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))
    bodies = join_small(bodies, scratch.cut(wanted), F.col("row_key") == F.col("wanted"), "inner").select("set_key", "copies", "text")
    linked = scratch.cut(exact_links(members, bodies, similarity))
    links = linked.groupBy("set_key").agg(F.sum("links").alias("links"))
    edges = linked.filter("set_key <> root").select(F.col("set_key").alias("a"), F.col("root").alias("b"))
    labels = components(linked.select(F.col("set_key").alias("node")).distinct(), edges).withColumnRenamed("node", "set_key")
    grouped = classes.select("set_key", "copies", "first_id").join(links, "set_key", "left").join(labels, "set_key", "left")
    grouped = scratch.cut(grouped.withColumn("label", F.coalesce("label", "set_key")))
    first = grouped.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = grouped.join(first, "label").select("set_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "label")
    rows = sketched.select("row_key", "doc_id", "set_key", "n_shingles").join(named, "set_key", "left")
    alone = F.col("set_key").isNull()
    out = cut_lineage(rows.select("row_key", "doc_id", "set_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                                  F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "label"))
    scratch.clear()
    return out


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each connected class: that of the smallest id. Wordless documents all stay."""
    found = similar_documents(docs, similarity, recall, doc_id, text)
    rows = found.filter("label is not null").groupBy("label", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("same"))
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))).alias("best")
    # Few rows go: they, and the kept ones that stand there more than once, are marked in a table of short rows.
    marks = rows.join(rows.groupBy("label").agg(best), "label").withColumn("goes", F.col("row_key") != F.col("best.row_key"))
    marks = cut_lineage(marks.filter("goes or same > 1").select(F.col("row_key").alias("marked"), "goes"))
    packed = docs.select(row_key(doc_id, text).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    both = join_small(packed, marks, F.col("row_key") == F.col("marked"), "left")
    repeated = both.filter("not goes").dropDuplicates(["row_key"])
    return both.filter("marked is null").unionByName(repeated).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
