"""Avro container files: hand-built bytes, cuts at every place, damaged and many files."""

import io
import json
import random
import zlib

import pyarrow as pa
import pytest

from waymark.sources import avro, nested_binary

SCHEMA = {"type": "record", "name": "row", "namespace": "own", "fields": [
    {"name": "id", "type": "long"}, {"name": "text", "type": ["null", {"type": "string", "avro.java.string": "String"}]}, {"name": "score", "type": "double"},
    {"name": "kind", "type": {"type": "enum", "name": "kind", "symbols": ["a", "b"]}}, {"name": "code", "type": {"type": "fixed", "name": "code", "size": 3}},
    {"name": "more", "type": {"type": "map", "values": "int"}}, {"name": "again", "type": ["null", "kind"]}, {"name": "mixed", "type": ["int", "string"]},
    {"name": "parts", "type": {"type": "array", "items": {"type": "record", "name": "part", "fields": [{"name": "x", "type": "float"}, {"name": "on", "type": "boolean"}]}}}]}


def long_(v):
    return avro.write_long(v)


def text_(s):
    return long_(len(s.encode())) + s.encode()


def value(i):
    """One row by the format's rules, and what it stands for."""
    import struct
    text = None if i % 3 == 0 else f"text {i} é"
    raw = long_(i - 50) + (long_(0) if text is None else long_(1) + text_(text)) + struct.pack("<d", i / 7) + long_(i % 2) + b"xyz"
    raw += long_(-1) + long_(len(text_("k") + long_(i))) + text_("k") + long_(i) + long_(0) + (long_(0) if i % 2 else long_(1) + long_(1))
    raw += (long_(0) + long_(-i) if i % 2 else long_(1) + text_("s"))
    n = i % 4
    raw += (long_(n) + b"".join(struct.pack("<f", j) + bytes([j % 2]) for j in range(n)) if n else b"") + long_(0)
    return raw, {"id": i - 50, "text": text, "score": i / 7, "kind": "ab"[i % 2], "code": b"xyz", "more": {"k": i}, "again": None if i % 2 else "b",
                 "mixed": {"member0": -i, "member1": None} if i % 2 else {"member0": None, "member1": "s"}, "parts": [{"x": float(j), "on": j % 2 == 1} for j in range(n)]}


def container(rows, codec="null", block=7, sync=b"0123456789abcdef"):
    out = avro.MAGIC + long_(2) + text_("avro.schema") + text_(json.dumps(SCHEMA)) + text_("avro.codec") + text_(codec) + long_(0) + sync
    for i in range(0, len(rows), block):
        data = b"".join(value(r)[0] for r in rows[i:i + block])
        if codec == "deflate":
            squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
            data = squeeze.compress(data) + squeeze.flush()
        out += long_(len(rows[i:i + block])) + long_(len(data)) + data + sync
    return out


def rows_of(data, start=0, stop=None):
    source = pa.PythonFile(io.BytesIO(data), "r")
    header = avro.read_header(source, len(data))
    of, out = avro.decoder(header.schema), []
    for n, block in avro.read_blocks(source, len(data), header, start, len(data) if stop is None else stop):
        at = 0
        for _ in range(n):
            row, at = of(block, at)
            out.append(row["id"])
        assert at == len(block)
    return out


def test_numbers():
    for v in [0, -1, 1, 63, -64, 64, 2 ** 31, -2 ** 31, 2 ** 63 - 1, -2 ** 63]:
        assert avro.read_long(avro.write_long(v), 0) == (v, len(avro.write_long(v)))
    assert avro.write_long(-1) == b"\x01" and avro.write_long(64) == b"\x80\x01"


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_a_file_is_cut_anywhere(codec):
    data = container(range(40), codec)
    whole = [i - 50 for i in range(40)]
    assert rows_of(data) == whole
    for cut in range(1, len(data)):
        assert rows_of(data, 0, cut) + rows_of(data, cut) == whole
    ranges = avro.plan_ranges([("a", len(data)), ("empty", 0), ("b", 10)], 100)
    assert sum(stop - start for r in ranges for _, _, start, stop in r.parts) == len(data) + 10


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_read_in_spark(spark, tmp_path, codec):
    avro.register(spark)
    (tmp_path / "one.avro").write_bytes(container(range(100), codec))
    (tmp_path / "_hidden.avro").write_bytes(b"nothing")
    for split in ("100", "100000"):
        got = spark.read.format("avro_files").option("splitBytes", split).load(str(tmp_path)).orderBy("id").collect()
        assert [r.asDict(recursive=True) for r in got] == [value(i)[1] for i in range(100)]
    fitted = spark.read.format("avro_files").schema("absent string, id long").load(f"{tmp_path}/one.avro")
    assert sorted(map(tuple, fitted.collect())) == [(None, i - 50) for i in range(100)]


def test_damaged_files(spark, tmp_path):
    avro.register(spark)
    data = container(range(70), block=10)
    (tmp_path / "whole.avro").write_bytes(data)
    (tmp_path / "damaged.avro").write_bytes(data[:-40])
    (tmp_path / "other.avro").write_bytes(b"no avro at all")
    with pytest.raises(Exception, match="damaged.avro|other.avro"):
        spark.read.format("avro_files").schema("id long").load(str(tmp_path)).collect()
    assert spark.read.format("avro_files").option("onBroken", "skip").schema("id long").load(str(tmp_path)).count() == 130


def test_many_small_files(spark, tmp_path):
    avro.register(spark)
    for i in range(2000):
        (tmp_path / f"{i}.avro").write_bytes(container([i]))
    read = spark.read.format("avro_files").option("splitBytes", str(1 << 18)).load(str(tmp_path))
    assert sorted(r.id for r in read.select("id").collect()) == [i - 50 for i in range(2000)]
    assert 2 <= read.rdd.getNumPartitions() < 20


def test_round_trip(spark, tmp_path):
    avro.register(spark)
    draw = random.Random(1)
    rows = [(i if i % 5 else None, draw.choice([None, "", "é" * 50]), [1.5, None] if i % 2 else [], {"a": None} if i % 3 else None, (i % 2 == 0, b"\x00")) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, s string, a array<float>, m map<string, int>, r struct<b: boolean, x: binary>")
    for codec in ("null", "deflate"):
        path = str(tmp_path / codec)
        df.repartition(3).write.format("avro_files").option("codec", codec).option("blockRows", 50).mode("append").save(path)
        back = spark.read.format("avro_files").load(path)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(Exception, match="Avro form"):
        spark.range(1).selectExpr("current_date() AS d").write.format("avro_files").mode("append").save(str(tmp_path / "date"))
    df.limit(1).write.format("avro_files").mode("overwrite").save(path)
    assert spark.read.format("avro_files").load(path).count() == 1


def test_tracks_from_avro(spark, tmp_path):
    tracks = spark.createDataFrame([("a", [(1.0, 2.0), (3.0, 4.0)], 2, "k", 5.0), ("b", None, None, None, None)],
                                   "fid string, points array<struct<x: double, y: double>>, num_track_points int, key string, total_distance double")
    tracks = tracks.selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:01' AS time_stamp")
    path = f"{tmp_path}/tracks.avro"
    nested_binary.write_collections(nested_binary.encode_tracks(tracks), path)
    back = nested_binary.decode_tracks(nested_binary.read_collections(spark, path)).select(*tracks.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, tracks.collect()))


def test_wrong_lengths_are_refused():
    with pytest.raises(ValueError, match="expected 8 bytes, found 4"):
        nested_binary._numbers(pa.array([b"12345678", b"1234", b"123456789012"], pa.binary()), ">f8")
    with pytest.raises(ValueError, match="ends early"):
        nested_binary._lines_of_wkb([b"\x00\x00\x00\x00\x02\x00\x00\x00\x05" + bytes(16)])
