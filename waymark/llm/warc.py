"""WARC archives with an externally merged capture index.

``write_archives`` gives each page a gzip member in a WARC file of its task. Of equal payloads the one of the smallest
page id is the response, the others are revisits without payload. Each task keeps its index entries as runs, sorted by
URL key and time. ``merge_runs`` deals the runs by key ranges, so that a URL with a third of all captures is cut by time,
and merges the k pieces of a range with a loser tree: ranges and positions give the captures of all URLs in order.
``read_archives`` fetches every record by file, offset and length and parses it.

Files are named at random, so a repeated task leaves a file that no index entry names. The folder is any that pyarrow
can write to by its URI.

Defined cases: null html is the empty payload; a null url is written as an empty target with an empty key; null page
ids stand last and are read back as null; rows equal in page id, url and payload are one response and revisits of it.
The capture time is ``EPOCH`` plus the page id in seconds, since pages carry none. Other columns are not read.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lineage, scratch_dir

EPOCH = dt.datetime(2024, 1, 1)
RUN = 100_000
FILE_BYTES = 256 << 20
RANGE = 100_000
_SALTS = 16
_ENTRY = ["urlkey", "captured", "page_id", "record_type", "digest", "file", "offset", "length", "run"]
_ENTRIES = "urlkey string, captured string, page_id bigint, record_type string, digest string, file string, offset bigint, length bigint, run string"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, urlkey string, captured string"


def url_key(url: str | None) -> str:
    """The host's labels from the right, then port, path and query; what cannot be split is taken as it is."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, revisit``: which page's payload came first."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("hash", F.sha1("payload"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "n")
    copies = rows.filter(F.length("payload") >= min_bytes).groupBy("hash", "page_id", "url").agg(F.count("*").alias("n"))
    first = copies.groupBy("hash").agg(F.min(order).alias("first"), F.sum("n").alias("copies")).filter("copies > 1")
    # A payload that a third of all pages share is dealt to several tasks.
    first = cut_lineage(first).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int"))
    met = salted.join(first, ["hash", "salt"], "left")
    same = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    met = met.withColumn("same", F.col("first").isNotNull() & same)
    tied = F.col("same") & (F.col("first.n") > 1)
    columns = ["page_id", "url", "payload", "hash", F.col("first.page_id").alias("refers_to"), (F.col("first").isNotNull() & ~F.col("same")).alias("revisit")]
    single = met.filter(~tied).select(*columns)
    place = F.row_number().over(Window.partitionBy("hash").orderBy("page_id"))
    equal = met.filter(tied).withColumn("place", place).select(*columns[:-1], (F.col("place") > 1).alias("revisit"))
    return single.unionByName(equal)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; ``digest`` is the payload's in base32."""
    name = lambda i: "" if i is None else str(i)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    unique = f":{uuid.uuid4()}" if revisit else ""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name(page_id)}:{digest}{unique}>",
            f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{name(refers_to)}:{digest}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def capture_time(page_id: int | None) -> dt.datetime:
    return EPOCH + dt.timedelta(seconds=(page_id or 0) % (10 ** 10))


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a record; a response's payload is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    if lines[0] != "WARC/1.1" or rest[int(fields["Content-Length"]):] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda uri: int(n) if (n := uri.split(":")[2]) else None
    refers = fields.get("WARC-Refers-To")
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(refers) if refers else None


class _Writer:
    """The archive files of one task, and its index entries as sorted runs."""

    def __init__(self, folder: str):
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.folder = folder
        self.entries: list[tuple] = []
        self.file, self.name, self.at = None, "", 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> None:
        if self.file is None or self.at >= FILE_BYTES:
            self.close()
            own = f"{uuid.uuid4().hex}.warc.gz"
            self.name, self.at = f"{self.folder}/{own}", 0
            self.file = self.files.open_output_stream(f"{self.root}/{own}", compression=None)
        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
        member = packer.compress(record(page_id, url, payload, digest, refers_to, revisit)) + packer.flush()
        self.file.write(member)
        kind = "revisit" if revisit else "response"
        self.entries.append((url_key(url), f"{capture_time(page_id):%Y%m%d%H%M%S}", page_id, kind, digest, self.name, self.at, len(member)))
        self.at += len(member)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()

    def run(self) -> pa.RecordBatch:
        name = uuid.uuid4().hex
        rows = [(*e, name) for e in sorted(self.entries, key=_key)]
        self.entries = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _types(), strict=True)], _ENTRY)


def _types() -> list[pa.DataType]:
    return [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _key(entry: tuple) -> tuple:
    return entry[0].encode(), entry[1], entry[2] is None, entry[2] or 0, entry[5], entry[6]


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives to ``folder`` (default: below the shared checkpoint folder) and return the runs of the index."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder)
        for batch in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                writer.add(page_id, url, payload, base32(digest), refers_to, revisit)
                if len(writer.entries) >= RUN:
                    yield writer.run()
        writer.close()
        if writer.entries:
            yield writer.run()

    rows = with_originals(pages, min_bytes).select("page_id", "url", "payload", "hash", "refers_to", "revisit")
    return cut_lineage(rows.mapInArrow(write, _ENTRIES))


class LoserTree:
    """Merges k sorted lists: every inner node keeps the loser of its match, the overall winner stands on top."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = len(runs)
        self.heads = [_key(r[0]) if r else None for r in runs]  # None: the run is used up and loses to all
        self.nodes = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, leaf: int, filling: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.nodes[node] < 0 and filling:
                self.nodes[node] = winner  # waits here for its opponent
                return
            if self._beats(self.nodes[node], winner):
                self.nodes[node], winner = winner, self.nodes[node]
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            winner = self.nodes[0]
            if self.heads[winner] is None:
                return
            run, at = self.runs[winner], self.at[winner]
            yield run[at]
            self.at[winner] = at + 1
            self.heads[winner] = _key(run[at + 1]) if at + 1 < len(run) else None
            self._play(winner)


def merge_runs(runs: DataFrame, rows_per_range: int = RANGE) -> DataFrame:
    """The entries of all runs with ``range`` and ``position``, which order them by URL key, time and page."""
    n_ranges = max(1, -(-runs.count() // rows_per_range))
    keys = ["urlkey", "captured", F.col("page_id").asc_nulls_last(), "file", "offset"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}  # one range: about rows_per_range entries
        for batch in batches:
            for entry in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                pieces.setdefault(entry[8], []).append(entry)
        merged = list(LoserTree(list(pieces.values())))
        if merged:
            columns = [pa.array(c, t) for c, t in zip(zip(*merged, strict=True), _types(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(merged)), pa.int64())], [*_ENTRY, "position"])

    dealt = runs.repartitionByRange(n_ranges, *keys).sortWithinPartitions("run", *keys)
    return dealt.select(*_ENTRY).mapInArrow(merge, _ENTRIES + ", position bigint").withColumn("range", F.spark_partition_id())


def read_archives(index: DataFrame) -> DataFrame:
    """One row per record of the archives, from the records themselves; each task reads whole files in order."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, None
        for batch in batches:
            out = []
            for urlkey, captured, file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    files, path = pafs.FileSystem.from_uri(file)
                    source, name = files.open_input_file(path), file
                source.seek(offset)
                out.append((*parse(zlib.decompress(source.read(length), 31)), urlkey, captured))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in _RECORD.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    # The entries are small and the records are not: one task per file, which adaptive execution must not put together.
    n_files = max(1, index.select("file").distinct().count())
    rows = index.repartition(n_files, "file").sortWithinPartitions("file", "offset").select("urlkey", "captured", "file", "offset", "length")
    return rows.mapInArrow(read, _RECORD)
