"""Counts in box windows by sums at their corners, against brute force; slices are cut small, so that all three ways count."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import cells
from waymark.operators import ranges, windows
from waymark.operators.windows import count_extents_in_windows, count_in_windows, selectivity, window_set_from_tables
from waymark.session import cut_lineage

BOX = "xmin double, ymin double, xmax double, ymax double"


def numbers(draw, n, steps):
    return [float(draw.randint(-steps, steps)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    points = list(zip(numbers(draw, 700, 12), numbers(draw, 700, 60)))  # few columns: many equal x
    points += [(5.0, 7.0)] * 300 + [(3.0, y) for y in numbers(draw, 300, 80)] + [(None, 1.0), (1.0, None), (float("nan"), 2.0), (180.0, 90.0), (-180.0, -90.0)]
    boxes = []
    for i in range(120):
        x, y, w, h = draw.randint(-14, 12), draw.randint(-70, 60), draw.choice([0, 0, 1, 5, 30]), draw.choice([0, 1, 8, 40])
        boxes.append((f"b{i}", float(x), float(y), float(x + w), float(y + h)))
    return points, boxes + [("world", -180.0, -90.0, 180.0, 90.0), ("dot", 5.0, 7.0, 5.0, 7.0), ("turned", 2.0, 2.0, 1.0, 3.0), ("empty", 100.0, 80.0, 101.0, 81.0)]


def known(v):
    return v is not None and v == v


def inside(points, box):
    return sum(known(x) and known(y) and box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in points)


@pytest.mark.parametrize("rows_per_slice", [7, 60, 400_000])
def test_points_in_boxes(spark, rows, rows_per_slice):
    points, boxes = rows
    df = spark.createDataFrame(points, "lon double, lat double")
    held = spark.createDataFrame(boxes, f"geom_id string, {BOX}")
    got = {r["geom_id"]: r["n"] for r in ranges.points_per_box(df, held, F.col("lon"), F.col("lat"), rows_per_slice=rows_per_slice).collect()}
    assert got == {g: inside(points, b) for g, *b in boxes if g != "turned"}


@pytest.mark.parametrize("rows_per_slice", [7, 400_000])
def test_boxes_meeting_boxes(spark, rows, rows_per_slice):
    _, boxes = rows
    held = spark.createDataFrame(boxes, f"geom_id string, {BOX}")
    features = held.drop("geom_id").unionByName(held.drop("geom_id").limit(40)).unionByName(spark.createDataFrame([(None, 1.0, 2.0, 2.0)], BOX))
    have = [tuple(r) for r in features.collect()]
    got = {r["geom_id"]: r["n"] for r in ranges.extents_per_box(features, held, rows_per_slice=rows_per_slice).collect()}
    meets = lambda e, q: None not in e and e[0] <= e[2] and e[0] <= q[2] and e[2] >= q[0] and e[1] <= q[3] and e[3] >= q[1]
    assert got == {g: sum(meets(e, b) for e in have) for g, *b in boxes if g != "turned"}


def test_sums_below():
    draw = np.random.default_rng(3)
    x, y, n = draw.integers(0, 9, 200).astype(float), draw.integers(0, 9, 200).astype(float), draw.integers(1, 4, 200)
    qx, qy = draw.integers(-1, 10, 90).astype(float), draw.integers(-1, 10, 90).astype(float)
    assert list(ranges._sums_below(x, y, n, qx, qy)) == [n[(x <= a) & (y <= b)].sum() for a, b in zip(qx, qy)]
    assert list(ranges._sums_below(x[:0], y[:0], n[:0], qx, qy)) == [0] * 90


@pytest.fixture
def no_rows_per_match(monkeypatch):
    """Counts of windows held as data must not make a row for each feature and window."""
    def fail(*_, **__):
        raise AssertionError("a row per match")
    for name in ("_match_shapes", "shape_chips"):
        monkeypatch.setattr(windows, name, fail)


def window_tables(spark, boxes, lo=None, hi=None):
    geoms = spark.createDataFrame(boxes, f"geom_id string, {BOX}")
    # b0 has two names, b1's name comes twice, "none" names no shape
    names = [(g, g) for g, *_ in boxes] + [("again", "b0"), ("b1", "b1"), ("none", "no such shape")]
    ends = [F.lit(v).cast("timestamp_ntz").alias(n) for v, n in ((lo, "lo"), (hi, "hi"))]
    return window_set_from_tables(geoms, spark.createDataFrame(names, "name string, geom_id string").select("*", *ends, F.lit(False).alias("closed")))


@pytest.mark.parametrize("times", [(None, None), ("2024-01-05", "2024-01-20"), ("2024-01-05", None), ("2024-01-09", "2024-01-07")])
def test_count_in_windows_held_as_data(spark, rows, no_rows_per_match, times):
    points, boxes = rows
    ts = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(pmod(fid, 30))")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "fid long, lon double, lat double").withColumn("ts", ts)
    day = lambda i: f"2024-01-{i % 30 + 1:02d}"
    asked = [p for i, p in enumerate(points) if (times[0] is None or day(i) > times[0]) and (times[1] is None or day(i) < times[1])]
    want = {g: inside(asked, b) if g != "turned" else 0 for g, *b in boxes}
    want = sorted([(g, n * (2 if g == "b1" else 1)) for g, n in want.items()] + [("again", want["b0"]), ("b1", 2 * want["b1"]), ("none", 0)])
    assert sorted(map(tuple, count_in_windows(df, window_tables(spark, boxes, *times)).collect())) == want


def test_count_extents_held_as_data(spark, rows, no_rows_per_match):
    boxes = [b for b in rows[1] if b[0] != "turned"]
    features = spark.createDataFrame([(i, *b[1:]) for i, b in enumerate(boxes)], f"fid long, {BOX}").withColumn("day", F.lit(None).cast("timestamp_ntz"))
    got = {r["name"]: r["n"] for r in count_extents_in_windows(features, window_tables(spark, boxes)).collect()}
    meets = lambda e, q: e[0] <= q[2] and e[2] >= q[0] and e[1] <= q[3] and e[3] >= q[1]
    for g, *b in boxes:
        assert got[g] == sum(meets(e[1:], b) for e in boxes) * (2 if g == "b1" else 1)


def test_selectivity_held_as_data(spark, rows, no_rows_per_match):
    points, boxes = rows
    points, boxes = [p for p in points if known(p[0]) and known(p[1])], [b for b in boxes if b[0] != "turned"]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "fid long, lon double, lat double")
    axis = lambda v, low, span, lv: min(int((v + low) // (span / 2 ** lv)), 2 ** lv - 1)
    want = {}
    for g, *b in boxes:
        lv = cells.level_for(b[2] - b[0], b[3] - b[1], 4)
        cell = lambda x, y: (axis(x, 180.0, 360.0, lv), axis(y, 90.0, 180.0, lv))
        (a, c), (d, e) = cell(*b[:2]), cell(*b[2:])
        want[g] = sum(a <= cell(*p)[0] <= d and c <= cell(*p)[1] <= e for p in points), inside(points, b)
    got = {r["name"]: (r["candidates"], r["matches"]) for r in selectivity(df, window_tables(spark, boxes)).collect() if r["name"] in want and r["name"] != "b1"}
    assert got == {g: v for g, v in want.items() if g != "b1"}


@pytest.mark.parametrize("ask", [selectivity, count_in_windows])
def test_windows_beyond_the_limits_stay_out_of_the_driver(spark, rows, monkeypatch, ask):
    """Joins with a row per window are not broadcast, however small Spark guesses the windows to be."""
    points, boxes = rows
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points) if known(p[0]) and known(p[1])], "fid long, lon double, lat double")
    boxes = [b for b in boxes if b[0] != "turned"]
    ws = window_tables(spark, boxes)
    want = sorted(map(tuple, ask(df, ws).collect()))
    join = ranges.salted_join  # what is below the joins with the windows is written, so that only they are in the plan
    monkeypatch.setattr(ranges, "salted_join", lambda *a, **k: cut_lineage(join(*a, **k)))
    got = ask(df, replace(ws, small=False))
    assert sorted(map(tuple, got.collect())) == want and len(want) >= len(boxes)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
