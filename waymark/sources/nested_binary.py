"""Track collections with binary attribute values.

One record holds ``featureType`` and ``simpleFeatureCollection``, an array of exactly one
``{fid, values, classifications}``. The values are in this order: WKB line, 8-byte milliseconds, ASCII
key, 8-byte double, 4-byte integer, all big-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.sources import avro

RECORD_SCHEMA = (
    "featureType struct<name: string, attributes: array<string>, types: array<string>, roles: array<string>>, "
    "simpleFeatureCollection array<struct<fid: string, values: array<binary>, classifications: string>>"
)
TRACK_SCHEMA = (
    "fid string, points array<struct<x: double, y: double>>, num_track_points int, time_millis bigint, "
    "key string, total_distance double"
)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Avro files or folders whose name ends in ``.avro``, else Parquet of the same nesting."""
    if path.rstrip("/").endswith(".avro"):
        return avro.register(spark).read.format("avro_files").schema(RECORD_SCHEMA).load(path)
    return spark.read.schema(RECORD_SCHEMA).parquet(path)


def write_collections(records: DataFrame, path: str, **options: str) -> None:
    """The inverse: Avro if the name ends in ``.avro``, else Parquet."""
    if path.rstrip("/").endswith(".avro"):
        avro.register(records.sparkSession)
        records.write.format("avro_files").options(**options).mode("append").save(path)
    else:
        records.write.parquet(path)


def _numbers(column: pa.Array, kind: str) -> pa.Array:
    """One big-endian number per value, null for null; a value of another length fails the job."""
    size = np.dtype(kind).itemsize
    values = column.to_pylist()
    wrong = next((v for v in values if v is not None and len(v) != size), None)
    if wrong is not None:
        raise ValueError(f"expected {size} bytes, found {len(wrong)}")
    numbers = np.frombuffer(b"".join(bytes(size) if v is None else v for v in values), kind).astype(kind[1:])
    return pa.array(numbers, mask=np.array([v is None for v in values], bool))


def _lines_of_wkb(column: list[bytes | None]) -> pa.Array:
    """WKB line strings to lists of points, null for null; lines of one byte order are decoded together."""
    counts = np.zeros(len(column), dtype=np.int64)
    bodies = []
    for i, wkb in enumerate(column):
        if wkb is None:
            continue
        if len(wkb) < 9 or len(wkb) < 9 + 16 * struct.unpack_from(">I" if wkb[0] == 0 else "<I", wkb, 5)[0]:
            raise ValueError(f"a WKB line string of {len(wkb)} bytes ends early")
        order = ">" if wkb[0] == 0 else "<"
        kind, counts[i] = struct.unpack_from(order + "II", wkb, 1)
        if kind != 2:
            raise ValueError(f"expected a WKB line string, found type {kind}")
        body = wkb[9:9 + 16 * counts[i]]
        bodies.append(body if order == ">" else np.frombuffer(body, "<f8").astype(">f8").tobytes())
    xy = np.frombuffer(b"".join(bodies), ">f8").astype("f8").reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=["x", "y"])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), points, mask=pa.array([w is None for w in column], pa.bool_()))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        yield pa.RecordBatch.from_arrays([
            col["fid"], _lines_of_wkb(col["geometry"].to_pylist()), _numbers(col["points"], ">i4"), _numbers(col["time"], ">i8"),
            pa.array([None if k is None else k.decode("ascii") for k in col["key"].to_pylist()], pa.string()), _numbers(col["distance"], ">f8"),
        ], names=["fid", "points", "num_track_points", "time_millis", "key", "total_distance"])


def decode_tracks(records: DataFrame) -> DataFrame:
    """Track rows. A record without exactly one feature, or with classifications, fails the job."""
    one = F.col("simpleFeatureCollection")
    feature = F.get(one, F.lit(0))
    checked = records.select(
        F.when(F.size(one) != 1, F.raise_error(F.lit("a record must hold exactly one feature")).cast("string"))
        .when(feature["classifications"].isNotNull(), F.raise_error(F.lit("classifications not null")).cast("string"))
        .otherwise(feature["fid"]).alias("fid"),
        *[F.get(feature["values"], F.lit(i)).alias(n) for i, n in enumerate(("geometry", "time", "key", "distance", "points"))])
    decoded = checked.mapInArrow(_decode, TRACK_SCHEMA)
    return decoded.withColumn("time_stamp", F.timestamp_millis("time_millis").cast("timestamp_ntz")).drop("time_millis")


def count_disagreements(tracks: DataFrame) -> DataFrame:
    """Tracks whose stored number of points is not the number of decoded points."""
    return tracks.filter(F.size("points") != F.col("num_track_points"))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = batch.column("points")
        offsets = points.offsets.to_numpy()
        flat = points.values
        lines = [struct.pack(">BII", 0, 2, e - s) for s, e in zip(offsets, offsets[1:])]
        xy = np.column_stack([flat.field("x").to_numpy(), flat.field("y").to_numpy()]).astype(">f8")
        geometry = [None if none else head + xy[s:e].tobytes() for none, head, s, e in zip(points.is_null().to_pylist(), lines, offsets, offsets[1:])]
        numbers = [pa.array([None if v is None else struct.pack(f, v) for v in batch.column(n).to_pylist()], pa.binary())
                   for n, f in (("time_millis", ">q"), ("total_distance", ">d"), ("num_track_points", ">i"))]
        yield pa.RecordBatch.from_arrays([batch.column("fid"), batch.column("key"), pa.array(geometry, pa.binary()), *numbers],
                                         names=["fid", "key", "geometry", "time", "distance", "points"])


def encode_tracks(tracks: DataFrame) -> DataFrame:
    """The inverse of :func:`decode_tracks`, for exports in this form."""
    millis = F.unix_millis(F.col("time_stamp").cast("timestamp")).alias("time_millis")
    packed = tracks.select("fid", "key", "points", "num_track_points", millis, "total_distance")
    coded = packed.mapInArrow(_encode, "fid string, key string, geometry binary, time binary, distance binary, points binary")
    empty = F.array().cast("array<string>")
    return coded.select(
        F.struct(F.lit("generated-tracks").alias("name"), empty.alias("attributes"), empty.alias("types"), empty.alias("roles")).alias("featureType"),
        F.array(F.struct(
            "fid", F.array("geometry", "time", F.col("key").cast("binary"), "distance", "points").alias("values"),
            F.lit(None).cast("string").alias("classifications"))).alias("simpleFeatureCollection"))
