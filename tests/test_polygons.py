"""Polygon features against every kind of window, by brute force over edges and vertices."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.times import ALL_TIME
from waymark.operators import polygons
from waymark.operators.polygons import polygons_in_windows, rings_edges
from waymark.operators.windows import WindowRow, box_shape, buffer_shape, polygon_shape, window_set

SQUARE = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
WIDE = [SQUARE(0, 0, 40), SQUARE(10, 10, 20)]  # with a wide hole
WINDOWS = {
    "wide": polygon_shape("wide", *WIDE), "island": polygon_shape("island", SQUARE(18, 18, 2)), "two": polygon_shape("two", SQUARE(-60, -60, 3), SQUARE(60, 60, 3)),
    "box": box_shape("box", (5, 5, 8, 8)), "dot": box_shape("dot", (20, 20, 20, 20)), "corner": polygon_shape("corner", [(40, 40), (45, 40), (45, 45), (40, 40)]),
    "near": buffer_shape("near", 20.0, 20.0, 400_000.0), "far": buffer_shape("far", -59.0, -59.0, 10_000.0),
}


def edges(rings):
    return [(a, b) for r in rings for a, b in zip(r, r[1:])]


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def sign(v):
    return (v > 0) - (v < 0)


def cross(p, q, a, b):
    boxes = all(min(p[i], q[i]) <= max(a[i], b[i]) and max(p[i], q[i]) >= min(a[i], b[i]) for i in (0, 1))
    return boxes and sign(turn(p, q, a)) * sign(turn(p, q, b)) <= 0 and sign(turn(a, b, p)) * sign(turn(a, b, q)) <= 0


def inside(p, rings):
    odd = False
    for a, b in edges(rings):
        if turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
            return True
        low, high = sorted((a, b), key=lambda v: v[1])
        if low[1] <= p[1] < high[1] and turn(low, high, p) > 0:
            odd = not odd
    return odd


def polygons_meet(one, other):
    return any(cross(*e, *f) for e in edges(one) for f in edges(other)) or any(inside(p, other) for r in one for p in r) or any(inside(p, one) for r in other for p in r)


def circle_meets(rings, shape):
    mx, my, metres = shape.circle
    if inside(geo.lonlat_of(mx, my), rings):
        return True
    for a, b in edges(rings):
        (ax, ay), (bx, by) = geo.merc_xy(*a), geo.merc_xy(*b)
        length = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((mx - ax) * (bx - ax) + (my - ay) * (by - ay)) / length)) if length else 0.0
        if (ax + t * (bx - ax) - mx) ** 2 + (ay + t * (by - ay) - my) ** 2 <= metres ** 2:
            return True
    return False


def window_rings(shape):
    xmin, ymin, xmax, ymax = shape.box
    return {"wide": WIDE, "two": [SQUARE(-60, -60, 3), SQUARE(60, 60, 3)], "island": [SQUARE(18, 18, 2)], "corner": [[(40, 40), (45, 40), (45, 45), (40, 40)]]}.get(
        shape.geom_id) or [[(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]]


def feature_rings():
    draw = random.Random(8)
    out = [WIDE, [SQUARE(12, 12, 3)], [SQUARE(15, 15, 10), SQUARE(17, 17, 4)], [SQUARE(-90, -90, 180)], [SQUARE(-90, -80, 170), SQUARE(-70, -70, 150)], [SQUARE(45, 45, 1)],
           [SQUARE(40, 0, 5)], [SQUARE(100, 50, 5), SQUARE(19, 19, 2)], [[(20.0, 20.0), (20.0, 20.0)]], [[(30, 30), (30, 30.5), (29, 31), (30, 30)]]]
    for _ in range(60):
        x, y, w = draw.randint(-70, 60), draw.randint(-65, 60), draw.choice([1, 2, 5, 10, 30])
        out.append([[(x, y), (x + w, y), (x + w, y + w), (x + w / 2, y + w / 4), (x, y + w), (x, y)]] + ([SQUARE(x + w, y + w, 1)] if draw.random() < 0.3 else []))
    return out


@pytest.fixture(scope="module")
def features(spark):
    rows = [(i, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in enumerate(feature_rings())] + [(1000, []), (1001, None), (1002, [[(1.0, 1.0)]])]
    df = spark.createDataFrame(rows, f"fid long, rings array<{geo.RING_TYPE}>")
    return df.select("fid", F.lit(None).cast("timestamp_ntz").alias("day"), rings_edges(F.col("rings")).alias("edges"))


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, features, small):
    ws = replace(window_set(spark, WINDOWS.values(), [WindowRow(n, n, ALL_TIME) for n in WINDOWS]), small=small)
    got = sorted(map(tuple, polygons_in_windows(features, ws).collect()))
    want = [(i, n) for i, rings in enumerate(feature_rings()) for n, s in WINDOWS.items()
            if (circle_meets(rings, s) if s.circle else polygons_meet(rings, window_rings(s)))]
    assert got == sorted(want)
    assert {(3, n) for n in ("wide", "dot", "near", "far", "two")} <= set(got) and not {(1, "wide"), (4, "island"), (4, "dot")} & set(got)


@pytest.mark.parametrize("name", ["wide", "box", "near", "dot"])
def test_one_window(spark, features, name):
    one = window_set(spark, [WINDOWS[name]], [WindowRow(name, name, ALL_TIME)])
    many = window_set(spark, WINDOWS.values(), [WindowRow(n, n, ALL_TIME) for n in WINDOWS])
    assert {r.fid for r in polygons_in_windows(features, one).collect()} == {r.fid for r in polygons_in_windows(features, many).filter(F.col("name") == name).collect()}


def test_plan_has_no_cross_join(spark, features):
    ws = window_set(spark, WINDOWS.values(), [WindowRow(n, n, ALL_TIME) for n in WINDOWS])
    plan = polygons_in_windows(features, ws)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_features_far_from_all_windows_go_first(spark, features, monkeypatch):
    """Only features whose box meets a window's box are looked at edge by edge, not all within the windows' envelope."""
    seen = []
    known = polygons.tracks_meeting_shapes
    monkeypatch.setattr(polygons, "tracks_meeting_shapes", lambda segments, *rest: seen.append(segments) or known(segments, *rest))
    corners = {n: box_shape(n, b) for n, b in {"low": (-90, -90, -89, -89), "high": (104, 54, 105, 55), "in high": (104, 54, 104.5, 55)}.items()}
    ws = window_set(spark, corners.values(), [WindowRow(n, n, ALL_TIME) for n in corners])
    found = {tuple(r) for r in polygons_in_windows(features, ws).collect()}
    assert found == {(3, "low"), (7, "high"), (7, "in high")}
    assert {r[0].fid for r in seen[0].select("_f").distinct().collect()} == {3, 7}
    assert len(polygons.window_boxes(ws)) == 2
