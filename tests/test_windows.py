"""One answer for each window, whatever the set it stands in."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.times import ALL_TIME, after, at, before, between, during
from waymark.operators.tracks import tracks_in_windows
from waymark.operators.windows import (
    WindowRow, box_shape, buffer_shape, extents_in_windows, points_in_windows, polygon_shape, window_set, window_set_from_tables,
)

HOLLOW = [(0, 0), (20, 0), (20, 4), (4, 4), (4, 20), (0, 20)]  # an L
SHAPES = [polygon_shape("l", HOLLOW), box_shape("box", (3, 3, 9, 9)), buffer_shape("circle", 10.0, 10.0, 400_000.0), polygon_shape("ring", [(5, 5), (15, 5), (15, 15), (5, 15)], [(8, 8), (12, 8), (12, 12), (8, 12)])]
SPANS = {"all": ALL_TIME, "none": between(None, None), "days": during("2024-01-02", "2024-01-04"), "from": after("2024-01-03"), "to": before("2024-01-03"), "at": at("2024-01-03")}
ROWS = [WindowRow(f"{s.geom_id}/{k}", s.geom_id, t) for s in SHAPES for k, t in SPANS.items()]


def from_tables(spark, ws):
    return window_set_from_tables(ws.geoms.drop("level"), ws.windows)


def all_ways(spark, ask):
    """The (feature, window) pairs asked alone, together and as tables."""
    alone = set()
    for row in ROWS:
        shape = next(s for s in SHAPES if s.geom_id == row.geom_id)
        alone |= ask(window_set(spark, [shape], [row]))
    together = window_set(spark, SHAPES, ROWS)
    assert ask(together) == alone
    assert ask(from_tables(spark, together)) == alone
    return alone


@pytest.fixture(scope="module")
def points(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, datetime(2024, 1, draw.randint(1, 5))]), draw.uniform(-2, 22), draw.uniform(-2, 22)) for i in range(400)]
    rows += [(1000, datetime(2024, 1, 3), 10.0, 10.0), (1001, None, 4.0, 4.0), (1002, datetime(2024, 1, 3), 9.0, 9.0), (1003, datetime(2024, 1, 3), 0.0, 20.0)]
    return spark.createDataFrame(rows, "fid long, ts timestamp_ntz, lon double, lat double").cache()


@pytest.mark.parametrize("mode", ["exact", "loose"])
def test_points(spark, points, mode):
    ask = lambda ws: {(r.fid, r.name) for r in points_in_windows(points, ws, mode=mode).select("fid", "name").collect()}
    found = all_ways(spark, ask)
    assert (1001, "l/all") in found and (1001, "l/none") in found and (1001, "l/days") not in found
    assert ((1000, "l/all") in found) is False and ((1000, "ring/all") in found) == (mode == "loose")


def inside(x, y, edges):
    odd = False
    for x1, y1, x2, y2 in edges:
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if side == 0 and y1 <= y <= y2 and min(x1, x2) <= x <= max(x1, x2):
            return True
        odd ^= y1 <= y < y2 and side > 0
    return odd


def edge_meets(box, e):
    a, b, c, d = box
    if min(e[0], e[2]) > c or max(e[0], e[2]) < a or e[1] > d or e[3] < b:
        return False
    turns = [(e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0]) for x in (a, c) for y in (b, d)]
    return min(turns) <= 0 <= max(turns)


def test_boxes(spark):
    draw = random.Random(2)
    rows = []
    for i in range(150):
        x, y = draw.uniform(-3, 21), draw.uniform(-3, 21)
        rows.append((i, datetime(2024, 1, 3), x, y, x + draw.choice([0.0, 0.5, 6.0]), y + draw.choice([0.0, 0.5, 6.0])))
    rows.append((999, datetime(2024, 1, 3), 9.0, 9.0, 11.0, 11.0))  # in the hole of the ring
    boxes = spark.createDataFrame(rows, "fid long, ts timestamp_ntz, xmin double, ymin double, xmax double, ymax double")
    asked = lambda ws: [(r.fid, r.name) for r in extents_in_windows(boxes, ws, "ts").collect()]
    found = all_ways(spark, lambda ws: set(asked(ws)))
    assert len(asked(window_set(spark, SHAPES, ROWS))) == len(found)
    for fid, _, *box in rows:
        for s in SHAPES:
            near = box[0] <= s.box[2] and box[2] >= s.box[0] and box[1] <= s.box[3] and box[3] >= s.box[1]
            if s.edges:
                near = near and (inside(box[0], box[1], s.edges) or any(edge_meets(box, e) for e in s.edges))
            elif s.circle:
                x, y = geo.merc_xy(min(max(10.0, box[0]), box[2]), min(max(10.0, box[1]), box[3]))
                near = (x - s.circle[0]) ** 2 + (y - s.circle[1]) ** 2 <= s.circle[2] ** 2
            assert ((fid, f"{s.geom_id}/all") in found) == near, (box, s.geom_id)


def test_tracks(spark):
    draw = random.Random(3)
    rows = [(f"t{i // 3}", i % 3, draw.uniform(-3, 23), draw.uniform(-3, 23)) for i in range(240)]
    ends = spark.createDataFrame([(t, q, x, y, x + draw.uniform(-3, 3), y + draw.uniform(-3, 3)) for t, q, x, y in rows] + [("still", 0, 13.6, 13.6, 13.6, 13.6)],
                                 "track string, seq int, x1 double, y1 double, x2 double, y2 double")
    times = ends.select("track").distinct().withColumn("t_start", F.lit("2024-01-03").cast("timestamp_ntz"))
    found = all_ways(spark, lambda ws: {(r.track, r.name) for r in tracks_in_windows(ends, times, ws).select("track", "name").collect()})
    assert ("still", "ring/at") in found and ("still", "circle/all") not in found  # in the corner of the circle's box


def test_stored_extents_are_read_once(spark, tmp_path):
    """Every extent that meets the asked box and time comes once, whatever cells it lies in; the scan prunes folders."""
    import random
    from waymark.functions.times import TimeSpan
    from waymark.sources.extents import read_extents, write_extents
    draw = random.Random(6)
    rows = []
    for i in range(300):
        x, y = draw.uniform(-180, 170), draw.uniform(-90, 85)
        rows.append((i, datetime(2024, 1 + i % 12, 1 + i % 28), x, y, min(180.0, x + draw.choice([0, 1, 60, 300])), min(90.0, y + draw.choice([0, 2, 50]))))
    rows += [(900, datetime(2024, 1, 5), None, None, None, None), (901, None, 0.0, 0.0, 1.0, 1.0), (902, datetime(2024, 1, 5), -45.0, -22.5, 45.0, 22.5)]
    df = spark.createDataFrame(rows, "fid long, t_start timestamp_ntz, xmin double, ymin double, xmax double, ymax double")
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    write_extents(df, str(tmp_path / "x"), box, "t_start")
    whole = read_extents(spark, str(tmp_path / "x"), df.schema, box)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, df.collect()))
    for asked in [(-10.0, -10.0, 50.0, 30.0), (-180.0, -90.0, 180.0, 90.0), (100.0, 50.0, 100.0, 50.0), (-45.0, -22.5, 45.0, 22.5)]:
        span = TimeSpan(datetime(2024, 2, 10), datetime(2024, 5, 3), True)
        part = read_extents(spark, str(tmp_path / "x"), df.schema, box, asked, span)
        meets = geo.boxes_meet(box, [F.lit(v) for v in asked])
        got = sorted(r.fid for r in part.filter(meets).collect())
        assert got == sorted(r[0] for r in rows if r[1] and r[2] is not None and span.lo <= r[1] <= span.hi and r[2] <= asked[2] and r[4] >= asked[0] and r[3] <= asked[3] and r[5] >= asked[1])
        assert len({r.fid for r in part.collect()}) == part.count()
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zx" in plan and "period" in plan.split("PartitionFilters")[1][:400] and "Exchange" not in plan


def test_track_queries_read_the_store(spark, sf):
    from waymark.plans.catalog import QUERIES
    plan = QUERIES["tracks_ca_7d"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "track-store" in plan and "Window" not in plan and "events.parquet" not in plan and "PartitionFilters: [isnotnull(zx" in plan
