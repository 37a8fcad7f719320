"""Predicates against plain Python, with points on edges and corners."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import cells, geo
from waymark.functions.times import after, before, between, during, in_span
from waymark.operators.tracks import segments_of, tracks_in_windows
from waymark.operators.windows import (
    WindowRow, box_shape, buffer_shape, count_in_windows, extents_in_windows, points_in_windows, polygon_shape, selectivity,
    window_set, window_set_from_tables,
)
from waymark.plans import presets as P, regions as R

HOLED = [[(0, 0), (10, 0), (10, 8), (5, 12), (0, 8), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)], [(20, 0), (24, 0), (22, 5), (20, 0)]]


def on_segment(p, a, b):
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (p[0] - a[0]) * (b[1] - a[1])
    return cross == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def inside(p, rings):
    odd = False
    for ring in rings:
        for a, b in zip(ring, ring[1:]):
            if on_segment(p, a, b):
                return True
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
    return odd


def grid_points():
    pts = [(x / 2, y / 2) for x in range(-4, 52) for y in range(-4, 28)]
    rng = random.Random(3)
    return pts + [(rng.uniform(-2, 25), rng.uniform(-2, 13)) for _ in range(400)]


def point_frame(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "fid long, lon double, lat double").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_polygon_with_hole_and_part(spark):
    pts = grid_points()
    want = {i for i, p in enumerate(pts) if inside(p, HOLED)}
    df = point_frame(spark, pts)
    lone = df.filter(geo.in_edges(F.col("lon"), F.col("lat"), geo.edges_literal(geo.edges_of_rings(HOLED))))
    assert {r.fid for r in lone.collect()} == want
    # the same through cells, together with a second shape
    ws = window_set(spark, [polygon_shape("h", *HOLED), box_shape("b", (0, 0, 1, 1))], [WindowRow("h", "h"), WindowRow("b", "b")])
    rows = points_in_windows(df, ws).select("fid", "name").collect()
    assert {r.fid for r in rows if r.name == "h"} == want
    assert {r.fid for r in rows if r.name == "b"} == {i for i, (x, y) in enumerate(pts) if 0 <= x <= 1 and 0 <= y <= 1}
    strict = df.filter(geo.strictly_in_edges(F.col("lon"), F.col("lat"), geo.edges_literal(geo.edges_of_rings(HOLED))))
    edge = {i for i, p in enumerate(pts) if any(on_segment(p, a, b) for r in HOLED for a, b in zip(r, r[1:]))}
    assert {r.fid for r in strict.collect()} == want - edge


def test_in_and_out_are_all_and_loose_holds_exact(spark):
    df = point_frame(spark, grid_points())
    ws = window_set(spark, [polygon_shape("h", *HOLED), box_shape("b", (1.2, 1.2, 7.3, 7.3))], [WindowRow("h", "h"), WindowRow("b", "b")])
    exact = {(r.fid, r.name) for r in points_in_windows(df, ws).collect()}
    loose = {(r.fid, r.name) for r in points_in_windows(df, ws, mode="loose").collect()}
    assert exact < loose
    test = geo.in_edges(F.col("lon"), F.col("lat"), geo.edges_literal(geo.edges_of_rings(HOLED)))
    assert df.filter(test).count() + df.filter(~test).count() == df.count()
    for row in selectivity(df, ws).collect():
        assert row.matches == len([1 for _, n in exact if n == row["name"]]) and row.candidates >= row.matches


def test_tiles_share_edges(spark):
    pts = [(1.0, 1.0), (0.5, 0.5), (2.0, 2.0), (1.0, 0.5)]
    shapes = [(f"{c}-{r}", box_shape(f"{c}-{r}", b)) for c, r, b in P.grid((0, 0, 2, 2), 2, 2)]
    ws = window_set(spark, *P.combine("T", shapes, [("", P.ALL_TIME)]))
    counts = {r["name"]: r.n for r in count_in_windows(point_frame(spark, pts), ws).collect()}
    assert counts == {"T-0-0": 1, "T-0-1": 3, "T-1-0": 2, "T-1-1": 2}  # a point on an edge is in both tiles


def test_poles_and_antimeridian(spark):
    pts = [(180.0, 90.0), (-180.0, -90.0), (180.0, 0.0), (0.0, 90.0)]
    ws = window_set(spark, [box_shape("world", (-180, -90, 180, 90)), box_shape("east", (170, -90, 180, 90))],
                    [WindowRow("world", "world"), WindowRow("east", "east"), WindowRow("empty", "east", between("2000-01-01", "2000-01-02"))])
    counts = {r["name"]: r.n for r in count_in_windows(point_frame(spark, pts), ws).collect()}
    assert counts == {"world": 4, "east": 2, "empty": 0}
    y = spark.range(1).select(geo.merc_y(F.lit(90.0)).alias("y"), geo.merc_y(F.lit(89.9999)).alias("z")).first()
    assert y.y == y.z


def test_time_spans(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 23:59:58", "2024-01-01 23:59:59", "2024-01-02 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    spans = {
        "open": (during("2024-01-01", "2024-01-02"), 2), "closed": (during("2024-01-01", "2024-01-02", closed=True), 4),
        "instant": (during("2024-01-01", "2024-01-01T00:00:01"), 1), "after": (after("2024-01-01T23:59:58"), 2),
        "before": (before("2024-01-01T00:00:02"), 1), "between": (between("2024-01-01", "2024-01-02"), 5),
    }
    for name, (span, n) in spans.items():
        assert df.filter(in_span(F.col("ts"), span)).count() == n, name
    ws = window_set(spark, [], [WindowRow(n, "everywhere", s) for n, (s, _) in spans.items()])
    assert {r["name"]: r.n for r in count_in_windows(df, ws).collect()} == {n: c for n, (_, c) in spans.items()}


def test_large_window_tables_give_the_same(spark):
    """The shuffled form with split hot cells against the broadcast form."""
    import waymark.operators.skew as skew
    df = point_frame(spark, grid_points())
    boxes = spark.createDataFrame([(f"b{i}", i * 0.7, i * 0.3, i * 0.7 + 2, i * 0.3 + 3) for i in range(30)], "geom_id string, xmin double, ymin double, xmax double, ymax double")
    windows = boxes.select(F.col("geom_id").alias("name"), "geom_id", F.lit(None).cast("timestamp_ntz").alias("lo"), F.lit(None).cast("timestamp_ntz").alias("hi"), F.lit(False).alias("closed"))
    ws = window_set_from_tables(boxes, windows)
    want = sorted((r["name"], r.n) for r in count_in_windows(df, ws).collect())
    ws.small = False
    before_limit = skew.salted_join.__defaults__
    skew.salted_join.__defaults__ = (before_limit[0], 20)  # 20 rows make a key hot
    try:
        got = sorted((r["name"], r.n) for r in count_in_windows(df, ws).collect())
    finally:
        skew.salted_join.__defaults__ = before_limit
    assert got == want and sum(n for _, n in want) > 0


def test_tracks_meet_shapes(spark):
    rng = random.Random(5)
    lines = {f"t{i}": [(rng.uniform(-3, 26), rng.uniform(-3, 13)) for _ in range(rng.randint(1, 4))] for i in range(60)}
    lines["same"] = [(1.0, 1.0), (1.0, 1.0)]
    lines["touch"] = [(-1.0, 8.0), (0.0, 8.0)]
    lines["in-hole"] = [(4.0, 4.0), (5.0, 5.0)]
    lines["far"] = [(-170.0, -80.0), (170.0, 80.0)]

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def sign(v):
        return (v > 0) - (v < 0)

    def cross(p, q, a, b):
        box = (min(p[0], q[0]) <= max(a[0], b[0]) and max(p[0], q[0]) >= min(a[0], b[0])
               and min(p[1], q[1]) <= max(a[1], b[1]) and max(p[1], q[1]) >= min(a[1], b[1]))
        return box and sign(turn(p, q, a)) * sign(turn(p, q, b)) <= 0 and sign(turn(a, b, p)) * sign(turn(a, b, q)) <= 0

    def meets(line, rings):
        pairs = list(zip(line, line[1:])) or [(line[0], line[0])]
        return any(inside(p, rings) or any(cross(p, q, a, b) for r in rings for a, b in zip(r, r[1:])) for p, q in pairs)

    square = [[(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]
    want = {(t, "h") for t, line in lines.items() if meets(line, HOLED)} | {(t, "s") for t, line in lines.items() if meets(line, square)}
    df = spark.createDataFrame([(t, [{"x": float(x), "y": float(y)} for x, y in line]) for t, line in lines.items()], "track string, points array<struct<x:double,y:double>>")
    times = df.select("track", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("t_start"))
    both = window_set(spark, [polygon_shape("h", *HOLED), box_shape("s", (2, 2, 4, 4))], [WindowRow("h", "h"), WindowRow("s", "s")])
    got = {(r.track, r["name"]) for r in tracks_in_windows(segments_of(df), times, both).collect()}
    assert got == want
    one = window_set(spark, [polygon_shape("h", *HOLED)], [WindowRow("h", "h")])
    assert {(r.track, r["name"]) for r in tracks_in_windows(segments_of(df), times, one).collect()} == {w for w in want if w[1] == "h"}
    assert ("same", "h") in want and ("touch", "h") in want and ("in-hole", "h") not in want


def test_extents_meet_boxes_once(spark):
    rng = random.Random(9)
    boxes = [(i, x := rng.uniform(-180, 170), y := rng.uniform(-90, 80), min(180.0, x + rng.choice([0.0, 1.0, 40.0])), min(90.0, y + rng.choice([0.0, 2.0, 30.0]))) for i in range(120)]
    shapes = [box_shape(f"w{i}", (a := rng.uniform(-180, 100), b := rng.uniform(-90, 50), a + w, b + w / 2)) for i, w in enumerate([0.5, 3, 20, 70, 0.0] * 6)]
    ws = window_set(spark, shapes, [WindowRow(s.geom_id, s.geom_id) for s in shapes])
    df = spark.createDataFrame([(*b,) for b in boxes], "fid long, xmin double, ymin double, xmax double, ymax double").withColumn("day", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = sorted((r.fid, r["name"]) for r in extents_in_windows(df, ws).collect())
    want = sorted((i, s.geom_id) for i, x0, y0, x1, y1 in boxes for s in shapes if x0 <= s.box[2] and x1 >= s.box[0] and y0 <= s.box[3] and y1 >= s.box[1])
    assert got == want


def test_buffer_ring_lies_in_the_circle(spark):
    lon, lat = 2.35, 48.86
    circle, ring = buffer_shape("c", lon, lat, 50_000), buffer_shape("r", lon, lat, 50_000, "ring")
    rng = random.Random(1)
    df = point_frame(spark, [(lon + rng.uniform(-1, 1), lat + rng.uniform(-1, 1)) for _ in range(500)])
    ws = window_set(spark, [circle, ring], [WindowRow("c", "c"), WindowRow("r", "r")])
    rows = points_in_windows(df, ws).collect()
    c, r = ({x.fid for x in rows if x["name"] == n} for n in "cr")
    assert r <= c and len(c) - len(r) < 0.05 * len(c) + 5
    assert len(ring.edges) == 32


@pytest.mark.parametrize("bits", [3, 6, 8])
def test_cover_holds_all_keys(spark, bits):
    box = R.BEIJING_BOX
    ranges = cells.cover(box, bits)
    rng = random.Random(bits)
    df = point_frame(spark, [(rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])) for _ in range(200)])
    keys = [r.z for r in df.select(cells.z2(F.col("lon"), F.col("lat")).alias("z")).collect()]
    assert all(any(lo <= z <= hi for lo, hi in ranges) for z in keys)
    assert ranges == sorted(ranges)


def test_level_forms_agree(spark):
    sizes = [(0.001, 0.002), (1.0, 1.0), (20.0, 5.0), (360.0, 180.0), (0.0, 0.0)]
    df = spark.createDataFrame(sizes, "w double, h double").select("w", "h", cells.level_expr(F.col("w"), F.col("h"), 4).alias("v"))
    assert all(r.v == cells.level_for(r.w, r.h, 4) for r in df.collect())


def test_mercator_round_trip():
    for lon, lat in [(0, 0), (2.35, 48.86), (-179, -60)]:
        back = geo.lonlat_of(*geo.merc_xy(lon, lat))
        assert math.isclose(back[0], lon, abs_tol=1e-9) and math.isclose(back[1], lat, abs_tol=1e-9)
