"""Polygon features (rings, holes, several parts) against window boxes, polygons and buffers.

A polygon meets a shape if its boundary meets it, or if a part of the shape lies inside of it without meeting its boundary;
then every point of that part does. So the edges of the features are asked as segments, split over cells with hot cells cut
(:mod:`waymark.operators.tracks`), and one point of each ring of the shapes looks for the features around it. Both are
even-odd tests over edges, so holes and parts need no mark. The feature's edges are its row; no row grows by its cells
on the first way, and on the second a feature is looked up at one cell level fit for its box.

Towards a buffer edges are straight on the Web Mercator map; its centre is tested in degrees.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions import cells, geo
from waymark.functions.times import TimeSpan, in_span
from waymark.operators.skew import salted_join
from waymark.operators.tracks import tracks_meeting_shapes
from waymark.operators.windows import EVERYWHERE, Box, WindowSet, match_times

MAX_BOXES = 64  # of windows that a feature's box is held against before its edges are looked at
LEVELS = 16  # levels at which features may be looked up; larger cells hold larger features


def rings_edges(rings: Column) -> Column:
    """Edges of an array of closed rings of ``struct<x, y>``; rings of fewer than two points have none."""
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), geo.ring_edges))


def edges_box(edges: Column) -> list[Column]:
    xs = F.flatten(F.transform(edges, lambda e: F.array(e["x1"], e["x2"])))
    return [F.array_min(xs), F.array_min(F.transform(edges, lambda e: e["y1"])), F.array_max(xs), F.array_max(F.transform(edges, lambda e: e["y2"]))]


def ring_points(geoms: DataFrame) -> DataFrame:
    """``geom_id, px, py``: a point of every ring of a window's shape, the corner of a box, the centre of a buffer.

    A ring begins where an edge has no end in common with the one before it; rings that touch there count as one.
    """
    same = lambda a, b: (a["x1"] == b["x1"]) & (a["y1"] == b["y1"]) | (a["x1"] == b["x2"]) & (a["y1"] == b["y2"]) | (
        (a["x2"] == b["x1"]) & (a["y2"] == b["y1"])) | (a["x2"] == b["x2"]) & (a["y2"] == b["y2"])
    begins = F.transform("edges", lambda e, i: F.when((i == 0) | ~same(e, F.get("edges", F.greatest(i - 1, F.lit(0)))), F.struct(e["x1"].alias("px"), e["y1"].alias("py"))))
    one = F.when(F.col("metres").isNotNull(), F.struct(geo.lon_of(F.col("mx")).alias("px"), geo.lat_of(F.col("my")).alias("py"))).otherwise(
        F.struct(F.col("xmin").alias("px"), F.col("ymin").alias("py")))
    points = F.when(F.col("edges").isNotNull(), F.filter(begins, lambda p: p.isNotNull())).otherwise(F.array(one))
    return geoms.select("geom_id", F.inline(points))


def _features_around(features: DataFrame, ws: WindowSet, key: str) -> DataFrame:
    """Distinct (key, geom_id) of features that hold a point of the shape."""
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    level = F.least(cells.level_expr(box[2] - box[0], box[3] - box[1], 2), F.lit(LEVELS))
    points = ring_points(ws.geoms).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    points = points.select("geom_id", "px", "py", cells.point_key(F.col("px"), F.col("py"), F.col("_level")).alias("_cell"))
    found = features.withColumn("_level", level).withColumn("_c", F.explode(cells.box_cells(*box, F.col("_level")))).withColumn(
        "_cell", cells.cell_key(F.col("_level"), F.col("_c.cx"), F.col("_c.cy")))
    # a point lies in one cell of a level, so a feature meets it once
    near = geo.in_box(F.col("px"), F.col("py"), box)
    inside = geo.in_edges(F.col("px"), F.col("py"), F.col("edges"))
    if ws.small:
        return found.join(F.broadcast(points), "_cell").filter(near & inside).select(key, "geom_id").distinct()
    candidates = salted_join(found.select(key, "_cell", *box), points, ["_cell"], [key]).filter(near).select(key, "geom_id", "px", "py")
    return salted_join(candidates, features.select(key, "edges"), [key], ["geom_id", "px", "py"]).filter(inside).select(key, "geom_id").distinct()


def window_boxes(ws: WindowSet) -> list[Box]:
    """Boxes that hold all shapes of the windows: those of the shapes that lie in no other's, or their envelope if these are many."""
    boxes = {s.box for s in ws.shapes}
    holds = lambda a, b: a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]
    outer = sorted(b for b in boxes if not any(a != b and holds(a, b) for a in boxes))
    return outer if 0 < len(outer) <= MAX_BOXES else [ws.envelope]


def polygons_in_windows(features: DataFrame, ws: WindowSet, time_col: str = "day", fid: str = "fid") -> DataFrame:
    """``fid, name`` of polygon features (``edges``, see :func:`rings_edges`) that meet the windows' shapes, boundaries included.

    Features without edges meet nothing. ``fid`` names a feature; rows of one ``fid`` and time are parts of it.
    """
    if ws.span.lo is not None or ws.span.hi is not None:
        features = features.filter(in_span(F.col(time_col), TimeSpan(ws.span.lo, ws.span.hi, True)))
    features = features.filter(F.size("edges") > 0).select(F.struct(F.col(fid).alias("fid"), F.col(time_col).alias("at")).alias("_f"), "edges")
    if not ws.spatial:
        met = features.select("_f", F.lit(EVERYWHERE).alias("geom_id")).distinct()
    else:
        # inlined, so that a feature's box is worked out once and not again for each comparison of the filter
        names = ("xmin", "ymin", "xmax", "ymax")
        box = F.struct(*[c.alias(n) for c, n in zip(edges_box(F.col("edges")), names, strict=True)])
        boxed = features.select("_f", "edges", F.inline(F.array(box)))
        if ws.envelope:
            boxed = boxed.filter(reduce(or_, [geo.boxes_meet([F.col(c) for c in names], [F.lit(v) for v in b]) for b in window_boxes(ws)]))
        boundary = tracks_meeting_shapes(boxed.select("_f", F.inline("edges")), ws, "_f")
        met = boundary.unionByName(_features_around(boxed, ws, "_f")).distinct()
    rows = met.select(F.col("_f.fid").alias(fid), F.col("_f.at").alias(time_col), "geom_id")
    return match_times(rows, ws, time_col, fid).select(fid, "name")
