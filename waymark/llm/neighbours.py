"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated by a seeded random orthogonal matrix and keeps one bit per dimension and one scalar, its inner
product with the code's corner of the cube. Code and scalar give an unbiased estimate of the inner product with a
query, and an error bound of ``epsilon`` standard deviations. For a query and a stretch of the index, the best
estimates are scored exactly first; then every vector whose upper bound reaches the k-th exact score is scored.

The index holds every vector once, in blocks. Queries are written to the shared folder and each task streams over them
for its blocks, so neither side passes through the driver or a shuffle, and a task holds one block and one file batch
of queries at a time.

Defined cases: null, empty or zero vectors, vectors with null or non-finite components and rows without id take no
part. Only vectors of the query's length are its candidates. Rows with the query's own id are its own; repeated rows of
other ids are candidates each, and a repeated query row is answered again. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import scratch_dir

BLOCK = 8192
QUERY_BATCH = 1024
_FIRST = 32
_BLOCKS = "dim int, ids array<bigint>, codes binary, scalars binary, vectors binary"
_FOUND = "query_row bigint, query_id bigint, vec_id bigint, score double"


@lru_cache(maxsize=2)
def rotation(dim: int, seed: int = 17) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))[0]


def valid_vectors(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a float64 matrix of the usable vectors, per length."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    usable = pc.and_(pc.is_valid(ids), pc.is_valid(vectors)).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[usable & (lengths > 0)]):
        rows = np.flatnonzero(usable & (lengths == dim))
        values = vectors.take(pa.array(rows)).flatten()
        matrix = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), int(dim))
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((matrix * matrix).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        yield rows[fine], matrix[fine]


def encode(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed one-bit codes and correction scalars of unit vectors."""
    rotated = matrix @ rotation(matrix.shape[1])
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(matrix.shape[1])


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in the order of the components: equal rows agree to the last bit."""
    total = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    left, right = total(vectors * vectors), total(query * query)
    with np.errstate(over="ignore", under="ignore"):
        norms = left * right
    norms = np.where(np.isfinite(norms) & (norms > 1e-290), np.sqrt(norms), np.sqrt(left) * np.sqrt(right))
    return total(vectors * query) / norms


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Write codes and vectors of every usable row, in blocks, below the shared checkpoint folder."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in valid_vectors(batch.column(0), batch.column(1)):
                ids = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
                for i in range(0, len(rows), BLOCK):
                    part = matrix[i:i + BLOCK]
                    codes, scalars = encode(part / np.sqrt((part * part).sum(axis=1, keepdims=True)))
                    row = [pa.array([part.shape[1]], pa.int32()), pa.array([ids[i:i + BLOCK]], pa.list_(pa.int64()))]
                    row += [pa.array([x.tobytes()], pa.binary()) for x in (codes, scalars, part)]
                    yield pa.RecordBatch.from_arrays(row, ["dim", "ids", "codes", "scalars", "vectors"])

    path = scratch_dir(vectors.sparkSession, "codes")
    chosen = vectors.select(F.col(vec_id).cast("bigint"), F.col(embedding))
    chosen.mapInArrow(blocks, _BLOCKS).write.option("maxRecordsPerFile", 8).parquet(path)
    return vectors.sparkSession.read.schema(_BLOCKS).parquet(path)


def _block_search(block: dict, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, epsilon: float) -> Iterator[tuple[int, int, float]]:
    """(query number, vector id, score) of the k best of a block for each query."""
    dim = block["dim"]
    vectors = np.frombuffer(block["vectors"], np.float64).reshape(-1, dim)
    codes = np.frombuffer(block["codes"], np.uint8).reshape(len(vectors), -1)
    scalars = np.frombuffer(block["scalars"], np.float64)
    corners = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    rotated = (queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))) @ rotation(dim)
    # The error of the estimate scales with the part of the vector that its code's corner does not cover.
    bound = epsilon * np.sqrt(np.maximum(1 - scalars * scalars, 0)) / scalars / np.sqrt(max(dim - 1, 1))
    estimates = (rotated.astype(np.float32) @ corners.T) / scalars.astype(np.float32)
    for q, (query, estimate) in enumerate(zip(queries, estimates, strict=True)):
        other = ids != own[q]
        upper = np.where(other, estimate + bound, -np.inf)
        first = np.argpartition(-np.where(other, estimate, -np.inf), min(_FIRST, len(ids)) - 1)[:_FIRST]
        first = first[other[first]]
        exact = np.sort(cosine(vectors[first], query))
        level = exact[-k] if len(exact) >= k else -np.inf
        chosen = np.flatnonzero((upper >= level - 1e-6) & other)
        score = cosine(vectors[chosen], query)
        for i in np.lexsort((ids[chosen], -score))[:k]:
            yield q, ids[chosen[i]], score[i]


def search(index: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = 3.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each query row, nearest first."""
    spark = index.sparkSession
    path = scratch_dir(spark, "queries")
    queries.select(F.monotonically_increasing_id().alias("query_row"), F.col(vec_id).cast("bigint").alias("query_id"),
                   F.col(embedding).cast("array<double>").alias("query")).write.parquet(path)
    files, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    names = [f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]

    def query_batches() -> Iterator[pa.RecordBatch]:
        for name in names:
            with files.open_input_file(name) as source:
                yield from pq.ParquetFile(source).iter_batches(QUERY_BATCH)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                ids = np.array(block["ids"], np.int64)
                for asked in query_batches():
                    for rows, matrix in valid_vectors(asked.column(1), asked.column(2)):
                        if matrix.shape[1] != block["dim"] or not len(rows):
                            continue
                        row_ids, own = (asked.column(c).take(pa.array(rows)).to_numpy(zero_copy_only=False) for c in (0, 1))
                        best = list(_block_search(block, ids, matrix, own, k, epsilon))
                        at = np.array([q for q, _, _ in best], np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row_ids[at]), pa.array(own[at]), pa.array([v for _, v, _ in best], pa.int64()), pa.array([s for _, _, s in best], pa.float64())],
                            ["query_row", "query_id", "vec_id", "score"])

    nearest = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = index.mapInArrow(found, _FOUND).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
