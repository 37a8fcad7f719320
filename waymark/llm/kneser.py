"""Interpolated modified Kneser-Ney model of word pairs.

Spark counts words and word pairs of the training texts: tasks send sorted blocks of hashes and counts per hash range,
and one task per range merges them. The ranges are the model: files of sorted 64-bit hashes with their counts in the
shared folder, which scoring tasks map into memory and search. A word's number is its place among all word hashes; a
pair's hash is a reversible scramble of its two numbers, so ranges fill evenly whatever the words, and a pair's words
are read back from its hash.

With c the count of a pair, N1+ numbers of distinct partners, and discounts D by count (1, 2, 3 and more) from the
counts of counts:
  p(w | v) = max(c(v w) - D, 0) / c(v) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v) * p(w)
  p(w) = max(N1+(. w) - D', 0) / N + g / (V + 1)
where n1..n3 count the followers of v by their count, N all distinct pairs, V the known words, g the discounted share;
an unknown word has the share of one word, and behind an unknown word p(w) stands alone. Texts are closed by an end
token and begin behind a start mark. The order is two: with three, the distinct triples alone exceed the disk limit.

The folder must be mounted on all executors (a ``file:`` path), since files are mapped into memory. A repeated task
writes its files anew under a private name and then renames them.

Defined cases: null and empty texts are an end token only; nothing to learn from gives V = N = 0 and every token the
probability 1; a null id is in training. Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.words import SPACED, hashed, mixed
from waymark.session import scratch_dir

END = mixed(np.array([0x656E64], np.uint64))[0]
PAIRS = 1 << 22  # of a block; bounds a task's memory
GROUP_WORDS = 1 << 21  # whose partners are added up together
_BLOCK = "bucket int, hashes binary, counts binary, keys bigint, total bigint"
_DONE = "bucket int, keys bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``."""
    x = x.astype(np.uint64, copy=True)
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def mounted(path: str) -> str:
    """The folder as the operating system names it."""
    plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"memory-mapped models need a mounted folder, not {path}")
    os.makedirs(plain, exist_ok=True)
    return plain


def pack(numbers: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane, compressed."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blocks(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block per hash range."""
    buckets = 1 << bits
    cuts = np.searchsorted(keys, (np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bits)))
    edges = np.concatenate([[0], cuts, [len(keys)]])
    used = np.flatnonzero(np.diff(edges))
    parts = [slice(edges[b], edges[b + 1]) for b in used]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([pack(keys[p]) for p in parts], pa.binary()), pa.array([pack_counts(counts[p]) for p in parts], pa.binary()),
         pa.array(np.diff(edges)[used]), pa.array([int(counts[p].sum()) for p in parts], pa.int64())], ["bucket", "hashes", "counts", "keys", "total"])


def _save(folder: str, name: str, values: np.ndarray) -> None:
    own = f"{folder}/.{uuid.uuid4().hex}.npy"
    os.makedirs(folder, exist_ok=True)
    np.save(own, values)
    os.replace(own, f"{folder}/{name}.npy")


def _merge(folder: str, kind: str, group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Merge the blocks of a range and save them; also its counts of counts."""
    keys = np.concatenate([unpack(h, n) for h, n in zip(group["hashes"], group["keys"], strict=True)])
    counts = np.concatenate([unpack_counts(c, n) for c, n in zip(group["counts"], group["keys"], strict=True)])
    keys, counts = summed(keys, counts)
    bucket = int(group["bucket"].iloc[0])
    _save(folder, f"{kind}-{bucket:06d}", keys)
    _save(folder, f"{kind}-count-{bucket:06d}", counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
    often = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    done = pd.DataFrame([[bucket, len(keys), int(counts.sum()), *often]], columns=["bucket", "keys", "total", "n1", "n2", "n3", "n4"])
    return keys, counts, done


class _Ranges:
    """The mapped files of one kind, by hash range."""

    def __init__(self, folder: str, kind: str, bits: int, buckets: list[int], sizes: list[int]):
        self.folder, self.kind, self.bits = folder, kind, bits
        self.base = dict(zip(buckets, np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64).tolist(), strict=True)) if buckets else {}
        self.files: dict[str, np.ndarray] = {}

    def file(self, kind: str, bucket: int) -> np.ndarray:
        name = f"{kind}-{bucket:06d}"
        if name not in self.files:
            self.files[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.files[name]

    def find(self, keys: np.ndarray, *kinds: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted keys: their numbers (-1 if absent), and the values of other files at the same places (else 0)."""
        number, values = np.full(len(keys), -1, np.int64), [np.zeros(len(keys)) for _ in kinds]
        if not len(keys):
            return number, values
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            own = int(bucket[a])
            if own not in self.base:
                continue
            held = self.file(self.kind, own)
            at = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
            hit = held[at] == keys[a:b]
            number[a:b] = np.where(hit, at + self.base[own], -1)
            for value, kind in zip(values, kinds, strict=True):
                value[a:b] = np.where(hit, self.file(kind, own)[at], 0)
        return number, values


def _numbered(hashes: np.ndarray, words: _Ranges, *kinds: str) -> tuple[np.ndarray, list[np.ndarray]]:
    distinct, inverse = np.unique(hashes, return_inverse=True)
    number, values = words.find(distinct, *kinds)
    return number[inverse], [v[inverse] for v in values]


def _token_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes with an end token behind each text, and the bounds of the texts."""
    for words in hashed(column, SPACED):
        n = len(words.bounds) - 1
        yield words.first, np.insert(words.hashes, words.bounds[1:], END), words.bounds + np.arange(n + 1)


def _followers(number: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The number of the token before each token."""
    before = np.concatenate([[start], number[:-1]])
    before[bounds[:-1]] = start
    return before


def _pair_hash(before: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mixed((before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))


def discounts(n: list[int]) -> list[float]:
    """D for counts 0, 1, 2 and from 3, from the numbers of keys with counts 1 to 4; 0.75 where they tell nothing."""
    out = [0.0]
    for k in (1, 2, 3):
        value = k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1] if n[0] and n[k - 1] else 0.75
        out.append(value if 0 < value <= k else 0.75)
    return out


def train(docs: DataFrame, folder: str | None = None, text: str = "text") -> dict:
    """Count and store the model of the texts of ``docs``; returns its description, which is also saved."""
    spark = docs.sparkSession
    folder = mounted(folder or scratch_dir(spark, "model"))
    bits = max(3, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    texts = docs.select(F.col(text).cast("string"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, tokens, _ in _token_chunks(batch.column(0)):
                held.append(np.unique(tokens, return_counts=True))
                n += len(held[-1][0])
                if n >= PAIRS:
                    yield from _blocks(*summed(*map(np.concatenate, zip(*held, strict=True))), bits)
                    held, n = [], 0
        if held:
            yield from _blocks(*summed(*map(np.concatenate, zip(*held, strict=True))), bits)

    def merge_words(group: pd.DataFrame) -> pd.DataFrame:
        return _merge(folder, "word", group)[2]

    ranges = texts.mapInArrow(count_words, _BLOCK).groupBy("bucket").applyInPandas(merge_words, _DONE).toPandas().sort_values("bucket")  # a row per range
    buckets, sizes = ranges["bucket"].tolist(), ranges["keys"].tolist()
    known, tokens = int(sum(sizes)), int(ranges["total"].sum())
    if known >= 1 << 32:
        raise ValueError("more than 2 ** 32 words")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = _Ranges(folder, "word", bits, buckets, sizes), [], 0
        for batch in batches:
            for _, hashes, bounds in _token_chunks(batch.column(0)):
                number, _ = _numbered(hashes, words)
                held.append(_pair_hash(_followers(number, bounds, known), number))
                n += len(number)
                if n >= PAIRS:
                    yield from _blocks(*np.unique(np.concatenate(held), return_counts=True), bits)
                    held, n = [], 0
        if held:
            yield from _blocks(*np.unique(np.concatenate(held), return_counts=True), bits)

    bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    # Word ranges in groups of about GROUP_WORDS, so that blocks per pair range follow the words, not the ranges.
    group_of = (bases[:-1] // GROUP_WORDS).tolist()
    firsts = [i for i, g in enumerate(group_of) if i == 0 or g != group_of[i - 1]]
    bounds_of = np.append(bases[firsts], known + 1) if firsts else np.array([0, 1])

    def merge_pairs(group: pd.DataFrame) -> pd.DataFrame:
        """The pairs of a range; and per group of word ranges, how many partners each word has there, by count."""
        pairs, counts, done = _merge(folder, "pair", group)
        both = unmixed(pairs)
        before, word = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = []
        for kind, numbers in ((0, word), (1, before[counts == 1]), (2, before[counts == 2]), (3, before[counts > 2])):
            numbers, n = np.unique(numbers, return_counts=True)
            edges = np.searchsorted(numbers, bounds_of)
            for i in np.flatnonzero(np.diff(edges)):
                part = slice(edges[i], edges[i + 1])
                rows.append((int(i), kind, pack(numbers[part].astype(np.uint64)), pack_counts(n[part]), len(n[part])))
        out = pd.DataFrame(rows, columns=["word_group", "kind", "hashes", "counts", "keys"])
        for name in ("bucket", "total", "n1", "n2", "n3", "n4"):
            out[name] = done[name].iloc[0]
        out["pairs"] = done["keys"].iloc[0]
        return out

    partners = "word_group int, kind int, hashes binary, counts binary, keys bigint, bucket int, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, pairs bigint"
    path = scratch_dir(spark, "partners")
    texts.mapInArrow(count_pairs, _BLOCK).groupBy("bucket").applyInPandas(merge_pairs, partners).write.parquet(path)
    found = spark.read.parquet(path)
    pair_ranges = found.select("bucket", "pairs", "n1", "n2", "n3", "n4").distinct().toPandas().sort_values("bucket")  # a row per range

    def add_partners(group: pd.DataFrame) -> pd.DataFrame:
        """Dense arrays for the words of a group, saved by range: distinct words before them, and followers by count."""
        group_number = int(group["word_group"].iloc[0])
        base, behind = int(bounds_of[group_number]), int(bounds_of[group_number + 1])
        dense = np.zeros((4, behind - base), np.int64)
        for kind, hashes, counts, n in zip(group["kind"], group["hashes"], group["counts"], group["keys"], strict=True):
            dense[kind, unpack(hashes, n).astype(np.int64) - base] += unpack_counts(counts, n)
        own = range(firsts[group_number], (firsts + [len(sizes)])[group_number + 1])
        pieces = [(buckets[i], int(bases[i]), int(bases[i + 1])) for i in own]
        if behind == known + 1:  # the start mark has the last number
            pieces.append((-1, known, known + 1))
        for bucket, begin, end in pieces:
            for kind in range(4):
                _save(folder, f"partner{kind}-{bucket:06d}", dense[kind, begin - base:end - base].astype(np.uint32))
        often = [int((dense[0] == k).sum()) for k in (1, 2, 3, 4)]
        return pd.DataFrame([[group_number, int((dense[0] > 0).sum()), int(dense[0].sum()), *often]], columns=["bucket", "keys", "total", "n1", "n2", "n3", "n4"])

    chosen = found.select("word_group", "kind", "hashes", "counts", "keys")
    partner_ranges = chosen.groupBy("word_group").applyInPandas(add_partners, _DONE).toPandas()
    end_count = _Ranges(folder, "word", bits, buckets, sizes).find(np.array([END], np.uint64), "word-count")[1][0]
    of = lambda frame: [int(frame[n].sum()) for n in ("n1", "n2", "n3", "n4")]
    lower, upper = of(partner_ranges), of(pair_ranges)
    kinds, pairs = int(partner_ranges["keys"].sum()), int(partner_ranges["total"].sum())
    low = discounts(lower)
    many = kinds - lower[0] - lower[1]
    model = {"folder": folder, "bits": bits, "buckets": buckets, "sizes": sizes, "pair_buckets": pair_ranges["bucket"].tolist(), "pair_sizes": pair_ranges["pairs"].tolist(),
             "words": known, "tokens": tokens, "texts": int(end_count[0]), "pairs": pairs, "discounts": discounts(upper), "lower_discounts": low,
             "left_over": (low[1] * lower[0] + low[2] * lower[1] + low[3] * many) / pairs if pairs else 1.0}
    with open(f"{folder}/model.json", "w") as out:
        json.dump(model, out)
    return model


class Scorer:
    """A model's mapped files in one task."""

    def __init__(self, model: dict):
        self.m = model
        self.words = _Ranges(model["folder"], "word", model["bits"], model["buckets"], model["sizes"])
        self.pairs = _Ranges(model["folder"], "pair", model["bits"], model["pair_buckets"], model["pair_sizes"])
        self.start = [float(np.load(f"{model['folder']}/partner{k}--00001.npy")[0]) for k in range(4)] if model["words"] else [0.0] * 4

    def log10(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: the model's log10 probability, the base's, and whether it is known."""
        m = self.m
        number, (count, inner, n1, n2, n3) = _numbered(hashes, self.words, "word-count", "partner0", "partner1", "partner2", "partner3")
        known = number >= 0
        base = np.log10((count + 1) / (m["tokens"] + m["words"] + 1))
        if not m["words"]:
            return np.zeros(len(hashes)), base, known
        low, high = np.array(m["lower_discounts"]), np.array(m["discounts"])
        single = np.maximum(inner - low[np.minimum(inner, 3).astype(np.int64)], 0) / m["pairs"] + m["left_over"] / (m["words"] + 1)
        before = _followers(number, bounds, m["words"])
        # Values of the token before, those of the start mark at the beginning of a text.
        first = np.zeros(len(hashes), bool)
        first[bounds[:-1]] = True
        shift = lambda x, at_start: np.where(first, at_start, np.concatenate([[0], x[:-1]]))
        followers = [shift(x, s) for x, s in zip((n1, n2, n3), self.start[1:], strict=True)]
        total = shift(count, m["texts"])
        seen = (before >= 0) & known & (total > 0)
        pair = np.zeros(len(hashes))
        distinct, inverse = np.unique(_pair_hash(before[seen], number[seen]), return_inverse=True)
        pair[seen] = self.pairs.find(distinct, "pair-count")[1][0][inverse]
        rest = sum(d * n for d, n in zip(high[1:], followers, strict=True))
        usable = total > 0
        total = np.where(usable, total, 1)
        both = np.maximum(pair - high[np.minimum(pair, 3).astype(np.int64)], 0) / total + rest / total * single
        return np.log10(np.where(usable, both, single)), base, known


def score(docs: DataFrame, model: dict, *keep: Column, text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` of each document."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for first, hashes, bounds in _token_chunks(batch.column(1)):
                values, base, known = scorer.log10(hashes, bounds)
                own = slice(first, first + len(bounds) - 1)
                out[0, own] = np.diff(bounds)
                for row, x in zip(out[1:], (known.astype(float), base, values), strict=True):
                    row[own] = np.add.reduceat(x, bounds[:-1])
            whole = lambda x: pa.array(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), whole(out[0]), whole(out[1]), pa.array(np.full(batch.num_rows, model["tokens"], np.int64)), pa.array(out[2]), pa.array(out[3]),
                 pa.array(10 ** np.minimum(-out[3] / np.maximum(out[0], 1), 300))], ["kept", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return rows.mapInArrow(score_all, schema).select("kept.*", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
