"""Avro object container files as a Spark data source, ``spark.read.format("avro_files")``, without a package.

Files are planned as byte ranges of about ``splitBytes``; small files share a task. A block belongs to the range in which
the sync marker before it begins, so a range finds its first block by looking for the marker and a file may be cut
anywhere. Blocks (codecs ``null`` and ``deflate``) are decoded to Arrow batches. Every file is read with its own schema and
fitted by field name to the schema of the read; a field that a file lacks is null.

Writing gives a file per task, under a hidden name until the job commits, so a repeated task leaves nothing behind.

Options: ``splitBytes``; ``onBroken`` is ``fail`` (default) or ``skip``, which leaves out files that are no Avro files and
what follows the last whole block of a damaged one; ``codec`` and ``blockRows`` for writing. A union of null and one type is that type, nullable; other unions
are structs of ``member0``, ``member1``, ... . Recursive schemas have no Spark form and are refused.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed values of the file format.
MAGIC = b"Obj\x01"
SYNC_SIZE = 16
_PRIMITIVES = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}

Decode = Callable[[bytes, int], tuple[Any, int]]
_BATCH_ROWS = 1000


class BrokenFile(ValueError):
    """A file that ends or goes on in a way the format does not allow."""


# ---- values --------------------------------------------------------------------------------------

def read_long(buf: bytes, at: int) -> tuple[int, int]:
    byte = buf[at]
    value, shift, at = byte & 127, 7, at + 1
    while byte & 128:
        byte = buf[at]
        value |= (byte & 127) << shift
        shift, at = shift + 7, at + 1
    return (value >> 1) ^ -(value & 1), at


def write_long(value: int) -> bytes:
    value = (value << 1) ^ (value >> 63)
    out = bytearray()
    while value & ~127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _read_bytes(buf: bytes, at: int) -> tuple[bytes, int]:
    n, at = read_long(buf, at)
    if n < 0 or at + n > len(buf):
        raise BrokenFile("a value goes on behind its block")
    return buf[at:at + n], at + n


def _read_string(buf: bytes, at: int) -> tuple[str, int]:
    value, at = _read_bytes(buf, at)
    return value.decode(), at


def _read_packed(form: struct.Struct) -> Decode:
    def read(buf: bytes, at: int) -> tuple[float, int]:
        return form.unpack_from(buf, at)[0], at + form.size
    return read


def _items(buf: bytes, at: int) -> Iterator[int]:
    """Item counts of the blocks of an array or map; the caller sends the place behind the items."""
    while True:
        n, at = read_long(buf, at)
        if n < 0:  # a size for skipping follows
            n, at = -n, read_long(buf, at)[1]
        at = yield n, at
        if n == 0:
            return


def decoder(schema: Any, named: dict[str, Any] | None = None, space: str = "") -> Decode:
    """A function that reads one value of the schema at a place and gives the place behind it."""
    named = {} if named is None else named
    if isinstance(schema, list):
        members = [decoder(s, named, space) for s in schema]
        kept = [i for i, s in enumerate(schema) if _name_of(s) != "null"]
        simple = len(kept) <= 1

        def union(buf: bytes, at: int):
            i, at = read_long(buf, at)
            value, at = members[i](buf, at)
            return (value if simple or i not in kept else {f"member{kept.index(i)}": value}), at
        return union
    if isinstance(schema, str):
        if schema not in _PRIMITIVES:
            found = named.get(schema if "." in schema or not space else f"{space}.{schema}") or named.get(schema)
            if found is None:
                raise ValueError(f"unknown or recursive Avro type {schema}")
            return found
        return {
            "null": lambda buf, at: (None, at), "boolean": lambda buf, at: (buf[at] == 1, at + 1), "int": read_long, "long": read_long,
            "float": _read_packed(struct.Struct("<f")), "double": _read_packed(struct.Struct("<d")), "bytes": _read_bytes, "string": _read_string}[schema]
    kind = schema["type"]
    if kind in ("record", "enum", "fixed"):
        space = schema.get("namespace", space)
        name = schema["name"] if "." in schema["name"] or not space else f"{space}.{schema['name']}"
        space = name.rpartition(".")[0]
    if kind == "record":
        fields = [(f["name"], decoder(f["type"], named, space)) for f in schema["fields"]]

        def read(buf: bytes, at: int):
            out = {}
            for field, of in fields:
                out[field], at = of(buf, at)
            return out, at
    elif kind == "enum":
        symbols = schema["symbols"]

        def read(buf: bytes, at: int):
            i, at = read_long(buf, at)
            return symbols[i], at
    elif kind == "fixed":
        size = schema["size"]

        def read(buf: bytes, at: int):
            return buf[at:at + size], at + size
    elif kind in ("array", "map"):
        of, is_map = decoder(schema["items" if kind == "array" else "values"], named, space), kind == "map"

        def read(buf: bytes, at: int):
            out: list = []
            blocks = _items(buf, at)
            n, at = next(blocks)
            while n:
                for _ in range(n):
                    if is_map:
                        key, at = _read_string(buf, at)
                    value, at = of(buf, at)
                    out.append((key, value) if is_map else value)
                n, at = blocks.send(at)
            return out, at
        return read
    else:
        return decoder(kind, named, space)
    named[name] = read
    return read


def _name_of(schema: Any) -> str:
    return schema if isinstance(schema, str) else schema.get("type", "") if isinstance(schema, dict) and isinstance(schema.get("type"), str) else ""


# ---- schemas -------------------------------------------------------------------------------------

def spark_type(schema: Any, named: dict[str, T.DataType] | None = None) -> T.DataType:
    named = {} if named is None else named
    if isinstance(schema, list):
        kept = [spark_type(s, named) for s in schema if _name_of(s) != "null"]
        return T.NullType() if not kept else kept[0] if len(kept) == 1 else T.StructType([T.StructField(f"member{i}", t) for i, t in enumerate(kept)])
    if isinstance(schema, str):
        plain = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
                 "bytes": T.BinaryType(), "string": T.StringType()}
        found = plain.get(schema) or named.get(schema.rpartition(".")[2])
        if found is None:
            raise ValueError(f"unknown or recursive Avro type {schema}")
        return found
    kind = schema["type"]
    if kind == "record":
        out = T.StructType([T.StructField(f["name"], spark_type(f["type"], named)) for f in schema["fields"]])
    elif kind in ("enum", "fixed"):
        out = T.StringType() if kind == "enum" else T.BinaryType()
    elif kind == "array":
        return T.ArrayType(spark_type(schema["items"], named))
    elif kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"], named))
    else:
        return spark_type(kind, named)
    named[schema["name"].rpartition(".")[2]] = out
    return out


def avro_schema(kind: T.DataType, name: str = "row") -> Any:
    """The schema that is written; every field may be null."""
    plain = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double",
             T.StringType: "string", T.BinaryType: "bytes"}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_schema(f.dataType, f"{name}_{f.name}")]} for f in kind]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", avro_schema(kind.elementType, f"{name}_item")]}
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return {"type": "map", "values": ["null", avro_schema(kind.valueType, f"{name}_value")]}
    if type(kind) not in plain:
        raise ValueError(f"no Avro form of {kind.simpleString()}; cast it first")
    return plain[type(kind)]


def encoder(schema: Any) -> Callable[[Any], bytes]:
    """A function that writes one value of a schema made by :func:`avro_schema`."""
    if isinstance(schema, list):
        of = encoder(schema[1])
        return lambda v: b"\x00" if v is None else b"\x02" + of(v)
    if isinstance(schema, dict):
        if schema["type"] == "record":
            fields = [encoder(f["type"]) for f in schema["fields"]]
            return lambda v: b"".join(of(x) for of, x in zip(fields, v, strict=True))
        of = encoder(schema.get("items") or schema.get("values"))
        if schema["type"] == "array":
            return lambda v: (write_long(len(v)) + b"".join(map(of, v)) if len(v) else b"") + b"\x00"
        text = encoder("string")
        return lambda v: (write_long(len(v)) + b"".join(text(k) + of(x) for k, x in v.items()) if v else b"") + b"\x00"
    if schema == "string":
        return lambda v: write_long(len(b := v.encode())) + b
    return {"boolean": lambda v: b"\x01" if v else b"\x00", "int": write_long, "long": write_long, "float": struct.Struct("<f").pack, "double": struct.Struct("<d").pack,
            "bytes": lambda v: write_long(len(v)) + bytes(v)}[schema]


# ---- files ---------------------------------------------------------------------------------------

def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def list_files(path: str) -> list[tuple[str, int]]:
    """(path within its file system, bytes) of a file, or of all files of a folder that are not hidden."""
    files, root = file_system(path)
    info = files.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    shown = lambda p: not any(part.startswith(("_", ".")) for part in p[len(root):].split("/"))
    return sorted((f.path, f.size) for f in files.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and shown(f.path))


@dataclass
class Header:
    schema: Any
    codec: str
    sync: bytes
    end: int


def read_header(source: pa.NativeFile, size: int) -> Header:
    n = 1 << 16
    while True:
        source.seek(0)
        buf = source.read(min(n, size))
        if buf[:4] != MAGIC:
            raise BrokenFile("not an Avro file")
        try:
            pairs, at = decoder({"type": "map", "values": "bytes"})(buf, 4)
            if at + SYNC_SIZE > len(buf):
                raise BrokenFile("the header ends early")
            break
        except (IndexError, BrokenFile):  # the header may be longer than what was read
            if n >= size:
                raise BrokenFile("the header ends early") from None
            n *= 8
    meta = dict(pairs)
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"codec {codec} is not read")
    return Header(json.loads(meta["avro.schema"]), codec, buf[at:at + SYNC_SIZE], at + SYNC_SIZE)


def _find_sync(source: pa.NativeFile, sync: bytes, start: int, stop: int) -> int | None:
    """The place of the first marker that begins in a range."""
    at, step = start, 1 << 20
    while at < stop:
        source.seek(at)
        buf = source.read(step + SYNC_SIZE - 1)
        found = buf.find(sync)
        if found >= 0:
            return at + found if at + found < stop else None
        if len(buf) < step:
            return None
        at += step
    return None


def read_blocks(source: pa.NativeFile, size: int, header: Header, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(number of rows, bytes) of the blocks of a range."""
    at = _find_sync(source, header.sync, max(start, header.end - SYNC_SIZE), stop)
    while at is not None and at < stop and at + SYNC_SIZE < size:
        source.seek(at + SYNC_SIZE)
        head = source.read(20)
        try:
            rows, used = read_long(head, 0)
            length, used = read_long(head, used)
        except IndexError:
            raise BrokenFile("a block ends early") from None
        source.seek(at + SYNC_SIZE + used)
        data = source.read(length) if 0 <= length <= size else b""
        at += SYNC_SIZE + used + length
        if rows < 0 or len(data) != length or source.read(SYNC_SIZE) != header.sync:
            raise BrokenFile("a block ends early")
        try:
            yield rows, zlib.decompress(data, -15) if header.codec == "deflate" else data
        except zlib.error as error:
            raise BrokenFile(str(error)) from None


@dataclass
class Ranges(InputPartition):
    """Parts of files for one task: path, bytes of the file, start and stop."""

    parts: list[tuple[str, int, int, int]]


def plan_ranges(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    out, current, held = [], [], 0
    for path, size in files:
        for start in range(0, size, split):
            stop = min(start + split, size)
            if current and held + stop - start > split:
                out.append(Ranges(current))
                current, held = [], 0
            current.append((path, size, start, stop))
            held += stop - start
    return out + ([Ranges(current)] if current else [])


class AvroReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.arrow = to_arrow_schema(schema)
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))
        self.skip = options.get("onBroken", "fail") == "skip"

    def partitions(self) -> list[Ranges]:
        return plan_ranges(list_files(self.path), self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files = file_system(self.path)[0]
        for path, size, start, stop in partition.parts:
            try:
                with files.open_input_file(path) as source:
                    header = read_header(source, size)
                    of = decoder(header.schema)
                    for n, data in read_blocks(source, size, header, start, stop):
                        rows, at = [], 0
                        for _ in range(n):
                            row, at = of(data, at)
                            rows.append(row)
                            if len(rows) == _BATCH_ROWS:
                                yield pa.RecordBatch.from_pylist(rows, self.arrow)
                                rows = []
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, self.arrow)
            except BrokenFile as error:
                if not self.skip:
                    raise BrokenFile(f"{path}: {error}") from None


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class AvroWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: Mapping[str, str], overwrite: bool):
        self.schema, self.path = avro_schema(schema), options["path"]
        self.codec, self.rows = options.get("codec", "deflate"), int(options.get("blockRows", 1000))
        if self.codec not in ("null", "deflate"):
            raise ValueError(f"codec {self.codec} is not written")
        files, root = file_system(self.path)
        if files.get_file_info(root).type == pafs.FileType.Directory and list_files(self.path):
            if not overwrite:
                raise ValueError(f"{self.path} holds files; use append or overwrite")
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> Written:
        files, root = file_system(self.path)
        files.create_dir(root, recursive=True)
        path = f"{root}/_{uuid.uuid4().hex}.avro"
        sync, of = os.urandom(SYNC_SIZE), encoder(self.schema)
        text, raw = encoder("string"), encoder("bytes")
        meta = {"avro.schema": json.dumps(self.schema).encode(), "avro.codec": self.codec.encode()}
        with files.open_output_stream(path) as out:
            out.write(MAGIC + write_long(len(meta)) + b"".join(text(k) + raw(v) for k, v in meta.items()) + b"\x00" + sync)

            def block(rows: list[bytes]) -> None:
                data = b"".join(rows)
                if self.codec == "deflate":
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
                    data = squeeze.compress(data) + squeeze.flush()
                out.write(write_long(len(rows)) + write_long(len(data)) + data + sync)

            held, size = [], 0
            for row in iterator:
                held.append(of(row))
                size += len(held[-1])
                if len(held) == self.rows or size > 1 << 22:
                    block(held)
                    held, size = [], 0
            if held:
                block(held)
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        before = list_files(self.path) if self.overwrite and files.get_file_info(root).type == pafs.FileType.Directory else []
        for message in messages:
            if message and message.path:
                files.move(message.path, f"{root}/part-{os.path.basename(message.path)[1:]}")
        for path, _ in before:
            files.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = file_system(self.path)
        for message in messages:
            if message and message.path:
                files.delete_file(message.path)


class AvroFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "avro_files"

    def schema(self) -> T.StructType:
        files, _ = file_system(self.options["path"])
        for path, size in list_files(self.options["path"]):
            try:
                with files.open_input_file(path) as source:
                    found = spark_type(read_header(source, size).schema)
            except BrokenFile as error:
                if self.options.get("onBroken", "fail") != "skip":
                    raise BrokenFile(f"{path}: {error}") from None
                continue
            return found if isinstance(found, T.StructType) else T.StructType([T.StructField("value", found)])
        raise ValueError(f"no Avro file in {self.options['path']}; give a schema")

    def reader(self, schema: T.StructType) -> AvroReader:
        return AvroReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> AvroWriter:
        return AvroWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make ``avro_files`` known to a session."""
    spark.dataSource.register(AvroFiles)
    return spark
