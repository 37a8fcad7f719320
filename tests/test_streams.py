"""Keyed sinks of streams: many batches, repeated batches, open windows at the end, late rows."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from waymark.streaming import jobs
from waymark.streaming.keyed import KeyedTable

SCHEMA = "k string, t timestamp_ntz, v long"


def batches(spark, tmp_path, parts, schema):
    """Files in the order of their parts: one file per batch."""
    import os
    out = tmp_path / "in"
    out.mkdir()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (file,) = Path(tmp_path / f"w{i}").glob("*.parquet")
        file.rename(out / f"{i:03}.parquet")
        os.utime(out / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return jobs.read_stream(spark, str(out), spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_latest_holds_one_row_per_key(spark, tmp_path):
    start = datetime(2024, 1, 1)
    parts = [[(f"k{(i * 7 + j) % 5}", start + timedelta(minutes=(i * 3 + j) % 11), i * 10 + j) for j in range(4)] + [(None, start, i)] for i in range(9)]
    stream = batches(spark, tmp_path, parts, SCHEMA)
    out = jobs.latest(stream, "k", "t", ["t", "v"], every=3)
    want = {}
    for k, t, v in (r for p in parts for r in p):
        want[k] = max(want.get(k, (datetime.min, -1)), (t, v))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((k, *tv) for k, tv in want.items()), key=str)
    # the output itself is one whole table with a row per key
    (folder,) = {str(Path(f.removeprefix("file://")).parent) for f in out.inputFiles()}
    assert sorted(p.name.split("-")[0] for p in Path(folder).parent.iterdir() if not p.name.startswith(".")) == ["table"]
    assert spark.read.parquet(folder).count() == len(want)


def test_repeated_batches_and_broken_compactions(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k string, v long")
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], make([]).schema, every=4)
    assert table.read().count() == 0
    changes = [[("a", 1), (None, 0)], [("b", 2)], [("a", 3)], [("c", 4), (None, 5)], [("a", 6)], [("b", None)]]
    for number, rows in enumerate(changes):
        table.save(make(rows), number)
        table.save(make(rows), number)  # as after a failure behind the write
    want = {"a": 6, "b": None, "c": 4, None: 5}
    assert {r.k: r.v for r in table.read().collect()} == want
    (tmp_path / "t" / "table-5").mkdir()  # a compaction that died: no mark of success
    assert {r.k: r.v for r in KeyedTable(spark, str(tmp_path / "t"), ["k"], make([]).schema).read().collect()} == want
    table.compact()
    table.compact()
    assert {r.k: r.v for r in table.read().collect()} == want and table.read().count() == 4
    table.save(make([("a", 7)]), 6)
    assert {r.k: r.v for r in table.read().collect()} == {**want, "a": 7}


def test_all_windows_come_out_once(spark, tmp_path):
    at = lambda hour, minute=0: datetime(2024, 1, 1, hour, minute)
    parts = [[(1, at(0, 5)), (2, at(0, 50)), (3, at(1, 1))], [(4, at(1, 10)), (5, at(0, 55))], [(6, at(5, 0))], [(7, at(0, 10)), (8, at(5, 1)), (9, at(4, 55))]]
    stream = batches(spark, tmp_path, [[(i, t, 1.0, 1.0) for i, t in p] for p in parts], "fid long, ts timestamp_ntz, lon double, lat double")
    out = jobs.all_cell_counts(stream, 3, "1 hour", "10 minutes", every=2)
    # row 7 is behind the watermark of 04:50 and is dropped; row 9 is late but within it
    assert sorted((r.start, r.n) for r in out.collect()) == [(at(0), 3), (at(1), 2), (at(4), 1), (at(5), 2)]
