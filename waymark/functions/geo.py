"""Geometry predicates and projections as Column expressions.

Edges are structs ``x1, y1, x2, y2`` with ``y1 <= y2`` (see :func:`edges_of_rings`). All tests are
closed: a point on a boundary belongs to the shape.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6378137.0  # metres, sphere of Web Mercator
MAX_MERCATOR_LAT = 89.9999  # the projection has no end at the poles; only they are moved
EDGE_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
RING_TYPE = "array<struct<x:double,y:double>>"


def merc_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS) * F.radians(lon)


def merc_y(lat: Column) -> Column:
    clamped = F.greatest(F.lit(-MAX_MERCATOR_LAT), F.least(F.lit(MAX_MERCATOR_LAT), lat))
    return F.lit(EARTH_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / F.lit(2.0)))


def lon_of(x: Column) -> Column:
    return F.degrees(x / F.lit(EARTH_RADIUS))


def lat_of(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(EARTH_RADIUS))) - F.lit(math.pi / 2))


def merc_xy(lon: float, lat: float) -> tuple[float, float]:
    """The same projection for one driver-side point, such as a buffer centre."""
    lat = max(-MAX_MERCATOR_LAT, min(MAX_MERCATOR_LAT, lat))
    return (
        EARTH_RADIUS * math.radians(lon),
        EARTH_RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2.0)),
    )


def lonlat_of(x: float, y: float) -> tuple[float, float]:
    return (
        math.degrees(x / EARTH_RADIUS),
        math.degrees(2.0 * math.atan(math.exp(y / EARTH_RADIUS)) - math.pi / 2),
    )


def reproject_point(lon: Column, lat: Column, source: int | None, target: int) -> tuple[Column, Column]:
    """(x, y) moved between EPSG:4326 and EPSG:3857; an unknown source leaves them unchanged."""
    if source is None or source == target:
        return lon, lat
    if (source, target) == (4326, 3857):
        return merc_x(lon), merc_y(lat)
    if (source, target) == (3857, 4326):
        return lon_of(lon), lat_of(lat)
    raise ValueError(f"no projection from {source} to {target}")


def reproject_ring(ring: Column, source: int | None, target: int) -> Column:
    """The same for an array of ``struct<x, y>``."""
    def move(p: Column) -> Column:
        x, y = reproject_point(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))
    return F.transform(ring, move)


def translate_ring(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def envelope(ring: Column) -> Column:
    """Bounding box struct of an array of ``struct<x, y>``."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def in_box(x: Column, y: Column, box: Sequence) -> Column:
    xmin, ymin, xmax, ymax = box
    return (x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax)


def boxes_meet(a: Sequence[Column], b: Sequence) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def box_contains(outer: Sequence, inner: Sequence) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def within_metres(lon: Column, lat: Column, mx, my, metres) -> Column:
    """Web Mercator distance to the projected centre (mx, my); not geodesic, as in a map buffer."""
    dx, dy = merc_x(lon) - mx, merc_y(lat) - my
    return dx * dx + dy * dy <= metres * metres


def box_within_metres(box: Sequence[Column], mx, my, metres) -> Column:
    """Any part of a lon/lat box within map metres of the projected centre (a box stays a box in the projection)."""
    zero = F.lit(0.0)
    dx = F.greatest(merc_x(box[0]) - mx, zero, mx - merc_x(box[2]))
    dy = F.greatest(merc_y(box[1]) - my, zero, my - merc_y(box[3]))
    return dx * dx + dy * dy <= metres * metres


def segment_within_metres(s: Sequence[Column], mx, my, metres) -> Column:
    """Any part of a segment, straight on the map, within map metres of the projected centre."""
    ax, ay, bx, by = merc_x(s[0]), merc_y(s[1]), merc_x(s[2]), merc_y(s[3])
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = F.when(length == 0, F.lit(0.0)).otherwise(((mx - ax) * dx + (my - ay) * dy) / length)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    x, y = ax + part * dx - mx, ay + part * dy - my
    return x * x + y * y <= metres * metres


def edges_of_rings(rings: Sequence[Sequence[tuple[float, float]]]) -> list[tuple[float, float, float, float]]:
    """Upward edges of closed rings. Holes need no mark: the even-odd rule subtracts them."""
    edges = []
    for ring in rings:
        points = [(float(x), float(y)) for x, y in ring]
        if points[0] != points[-1]:
            points.append(points[0])
        for (x1, y1), (x2, y2) in zip(points, points[1:]):
            edges.append((x1, y1, x2, y2) if y1 <= y2 else (x2, y2, x1, y1))
    return edges


def ring_edges(ring: Column) -> Column:
    """Upward edges of one closed ring held as a column."""
    n = F.size(ring)
    pairs = F.zip_with(
        F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1),
        lambda a, b: F.struct(
            F.when(a["y"] <= b["y"], a["x"]).otherwise(b["x"]).alias("x1"),
            F.least(a["y"], b["y"]).alias("y1"),
            F.when(a["y"] <= b["y"], b["x"]).otherwise(a["x"]).alias("x2"),
            F.greatest(a["y"], b["y"]).alias("y2"),
        ),
    )
    return pairs


def edges_literal(edges: Sequence[tuple[float, float, float, float]]) -> Column:
    """A constant array; one expression text however many edges there are."""
    rows = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {float(v)!r}D" for n, v in zip(("x1", "y1", "x2", "y2"), e)) + ")" for e in edges)
    return F.expr(f"array({rows})")


def _side(x: Column, y: Column, e: Column) -> Column:
    # > 0: the upward edge passes to the right of the point; 0: the point is on its line
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def in_edges(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test in one pass: bit 0 holds the parity of crossings, bit 1 a boundary hit."""
    def step(acc: Column, e: Column) -> Column:
        side = _side(x, y, e)
        in_span = (y >= e["y1"]) & (y <= e["y2"])
        on_edge = in_span & (side == 0) & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"]))
        crosses = in_span & (y < e["y2"]) & (side > 0)
        return (
            F.when(~in_span, acc).when(on_edge, acc.bitwiseOR(F.lit(2)))
            .when(crosses, acc.bitwiseXOR(F.lit(1))).otherwise(acc)
        )
    return F.aggregate(edges, F.lit(0), step) > 0


def strictly_in_edges(x: Column, y: Column, edges: Column) -> Column:
    """Inside and not on the boundary."""
    on_edge = F.exists(edges, lambda e: (
        (_side(x, y, e) == 0) & (y >= e["y1"]) & (y <= e["y2"])
        & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"]))
    ))
    return in_edges(x, y, edges) & ~on_edge


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_meets_box(s: Sequence[Column], box: Sequence) -> Column:
    """Separating axes: the boxes overlap and the corners are not all on one side of the line."""
    x1, y1, x2, y2 = s
    xmin, ymin, xmax, ymax = [b if isinstance(b, Column) else F.lit(float(b)) for b in box]
    overlap = boxes_meet(
        (F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)), (xmin, ymin, xmax, ymax)
    )
    turns = [_turn(x1, y1, x2, y2, cx, cy) for cx in (xmin, xmax) for cy in (ymin, ymax)]
    return overlap & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)


def segment_crosses_edge(s: Sequence[Column], e: Column) -> Column:
    """Closed segment against one edge, collinear overlap included."""
    x1, y1, x2, y2 = s
    overlap = boxes_meet(
        (F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)),
        (F.least(e["x1"], e["x2"]), e["y1"], F.greatest(e["x1"], e["x2"]), e["y2"]),
    )
    o1 = F.signum(_turn(x1, y1, x2, y2, e["x1"], e["y1"]))
    o2 = F.signum(_turn(x1, y1, x2, y2, e["x2"], e["y2"]))
    o3 = F.signum(_turn(e["x1"], e["y1"], e["x2"], e["y2"], x1, y1))
    o4 = F.signum(_turn(e["x1"], e["y1"], e["x2"], e["y2"], x2, y2))
    return overlap & (o1 * o2 <= 0) & (o3 * o4 <= 0)


def segment_meets_edges(s: Sequence[Column], edges: Column) -> Column:
    """Segment against a polygon: one end inside, or an edge crossed."""
    return in_edges(s[0], s[1], edges) | F.exists(edges, lambda e: segment_crosses_edge(s, e))


def circle_ring(mx: float, my: float, metres: float, vertices: int = 32) -> list[tuple[float, float]]:
    """Buffer ring in degrees with the given number of vertices, closed."""
    angles = [2 * math.pi * i / vertices for i in range(vertices)]
    ring = [lonlat_of(mx + metres * math.cos(a), my + metres * math.sin(a)) for a in angles]
    return ring + ring[:1]
