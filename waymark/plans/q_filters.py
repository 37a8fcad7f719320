"""Predicates on features."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.times import after, at, before, between, during, in_span
from waymark.operators.tracks import tracks_meeting_shapes
from waymark.operators.windows import (
    WindowRow, count_in_windows, envelope_shape, polygon_shape, shape_test, window_set,
)
from waymark.plans import presets as P, regions as R
from waymark.plans.fixtures import geo_boxes, geo_events, geo_orders, segments_for, with_ctes
from waymark.plans.registry import query
from waymark.plans.sqltext import count_windows_sql, hits_cte, num, shapes_cte, span_literal

def lonlat():
    return F.col("lon"), F.col("lat")


def _between_sql(box, x="lon", y="lat"):
    return f"{x} BETWEEN {num(box[0])} AND {num(box[2])} AND {y} BETWEEN {num(box[1])} AND {num(box[3])}"


@query("flt_bbox", with_ctes("geo_events", f"SELECT fid, lon, lat FROM geo_events WHERE {_between_sql(R.BEIJING_BOX)}"))
def flt_bbox(spark, sf):
    return geo_events(spark, sf).filter(geo.in_box(*lonlat(), R.BEIJING_BOX)).select("fid", "lon", "lat")


_FR = P.france(bbox=True).box


@query("flt_bbox_extents", with_ctes(
    "geo_boxes", f"SELECT fid FROM geo_boxes WHERE xmin <= {num(_FR[2])} AND xmax >= {num(_FR[0])} "
    f"AND ymin <= {num(_FR[3])} AND ymax >= {num(_FR[1])}"))
def flt_bbox_extents(spark, sf):
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return geo_boxes(spark, sf).filter(geo.boxes_meet(box, _FR)).select("fid")


_LOOSE = P.beijing_box()


@query("flt_bbox_loose", with_ctes("geo_events", "SELECT fid FROM hits", shapes_cte([_LOOSE]), hits_cte("geo_events", "loose")))
def flt_bbox_loose(spark, sf):
    return geo_events(spark, sf).filter(shape_test(_LOOSE, *lonlat(), "loose")).select("fid")


_BJ = P.beijing()


@query("flt_intersects_polygon", with_ctes("geo_events", "SELECT fid FROM hits", shapes_cte([_BJ]), hits_cte("geo_events")))
def flt_intersects_polygon(spark, sf):
    return geo_events(spark, sf).filter(shape_test(_BJ, *lonlat())).select("fid")


_CA = P.california()
# the same test as nested loops: an end inside, or an edge and a segment that turn both ways
SEGMENT_HITS_SQL = (
    "starts AS (SELECT row_number() OVER (ORDER BY fid1) AS fid, track, x1 AS lon, y1 AS lat, x1, y1, x2, y2 FROM segs), "
    + hits_cte("starts") + ", crossings AS (SELECT s.track, g.geom_id FROM starts s JOIN shapes g ON "
    "least(s.x1,s.x2) <= g.xmax AND greatest(s.x1,s.x2) >= g.xmin AND least(s.y1,s.y2) <= g.ymax AND greatest(s.y1,s.y2) >= g.ymin "
    "JOIN edges e ON e.geom_id = g.geom_id WHERE "
    "least(s.x1,s.x2) <= greatest(e.x1,e.x2) AND greatest(s.x1,s.x2) >= least(e.x1,e.x2) AND least(s.y1,s.y2) <= e.y2 AND greatest(s.y1,s.y2) >= e.y1 AND "
    "sign((s.x2-s.x1)*(e.y1-s.y1)-(s.y2-s.y1)*(e.x1-s.x1))*sign((s.x2-s.x1)*(e.y2-s.y1)-(s.y2-s.y1)*(e.x2-s.x1)) <= 0 AND "
    "sign((e.x2-e.x1)*(s.y1-e.y1)-(e.y2-e.y1)*(s.x1-e.x1))*sign((e.x2-e.x1)*(s.y2-e.y1)-(e.y2-e.y1)*(s.x2-e.x1)) <= 0), "
    "track_hits AS (SELECT DISTINCT track, geom_id FROM (SELECT s.track, h.geom_id FROM hits h JOIN starts s ON s.fid = h.fid "
    "UNION ALL SELECT track, geom_id FROM crossings))"
)


@query("flt_intersects_line", with_ctes("segs", "SELECT track FROM track_hits", shapes_cte([_CA]), SEGMENT_HITS_SQL))
def flt_intersects_line(spark, sf):
    ws = window_set(spark, [_CA], [WindowRow("in-california", _CA.geom_id)])
    return tracks_meeting_shapes(segments_for(spark, sf, ws), ws).select("track")


@query("flt_stab_point", with_ctes(
    "geo_boxes", "SELECT fid, xmin, ymin, xmax, ymax FROM geo_boxes WHERE xmin <= 2.5e0 AND xmax >= 2.5e0 AND ymin <= 48.9e0 AND ymax >= 48.9e0"))
def flt_stab_point(spark, sf):
    x, y = F.lit(2.5), F.lit(48.9)
    return geo_boxes(spark, sf).filter(
        (F.col("xmin") <= x) & (F.col("xmax") >= x) & (F.col("ymin") <= y) & (F.col("ymax") >= y)
    ).select("fid", "xmin", "ymin", "xmax", "ymax")


@query("flt_contains", with_ctes(
    "geo_boxes", f"SELECT fid FROM geo_boxes WHERE {num(_FR[0])} <= xmin AND {num(_FR[1])} <= ymin AND {num(_FR[2])} >= xmax AND {num(_FR[3])} >= ymax"))
def flt_contains(spark, sf):
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return geo_boxes(spark, sf).filter(geo.box_contains([F.lit(v) for v in _FR], box)).select("fid")


@query("flt_disjoint", with_ctes(
    "geo_events", "SELECT fid FROM geo_events WHERE fid NOT IN (SELECT fid FROM hits)", shapes_cte([_BJ]), hits_cte("geo_events")))
def flt_disjoint(spark, sf):
    return geo_events(spark, sf).filter(
        F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~shape_test(_BJ, *lonlat())).select("fid")


def _region_boxes():
    shapes = {
        "beijing": _BJ, "beijing-center": P.beijing_center(), "france": P.france(), "california": _CA, "usa": P.usa(),
        "south-america": polygon_shape("south-america", *[r for rings in R.SOUTH_AMERICA.values() for r in rings]),
        "russia": polygon_shape("russia", *R.RUSSIA), "atlantic": polygon_shape("atlantic", *R.ATLANTIC),
    }
    return P.combine("bbox", [(n, envelope_shape(f"{n}-box", s)) for n, s in shapes.items()], [("", P.ALL_TIME)])


_BOXES = _region_boxes()


@query("flt_in_bbox_of_region", count_windows_sql("geo_orders", *_BOXES, time_col="day"))
def flt_in_bbox_of_region(spark, sf):
    return count_in_windows(geo_orders(spark, sf), window_set(spark, *_BOXES), "day")


def _time_query(name, span, table="geo_events", ts="ts"):
    source = {"geo_events": geo_events, "geo_orders": geo_orders}[table]

    @query(name, with_ctes(table, f"SELECT fid, {ts} FROM {table} WHERE {span_literal(ts, span)}"))
    def run(spark, sf):
        return source(spark, sf).filter(in_span(F.col(ts), span)).select("fid", ts)
    return run


_time_query("flt_during", during("2024-01-08", "2024-01-14"))
_time_query("flt_tequals", during("1997-03-05", "1997-03-05T00:00:01"), "geo_orders", "day")
_time_query("flt_after", after("2024-01-20T12:00:00"))
_time_query("flt_before", before("2024-01-05T06:00:00"))
_time_query("flt_interval_inclusive", between("1997-03-05", "1997-04-05"), "geo_orders", "day")
assert at("1997-03-05") == during("1997-03-05", "1997-03-05T00:00:01")

_MINUS2 = ([], [WindowRow(r.name.rsplit("-", 3)[0], "everywhere", r.span)
                for r in P.tracks_grid("flt", "5DAY", [1], range(6), 2024)[1] if r.geom_id == "1-0-0"])


@query("flt_during_minus2", count_windows_sql("geo_events", *_MINUS2))
def flt_during_minus2(spark, sf):
    return count_in_windows(geo_events(spark, sf), window_set(spark, *_MINUS2))


_WEEK = during("2024-01-08", "2024-01-14T23:59:59", minus_seconds=0)


@query("flt_and", with_ctes("geo_events", f"SELECT fid, ts, lon, lat FROM geo_events WHERE {_between_sql(R.BEIJING_BOX)} AND {span_literal('ts', _WEEK)}"))
def flt_and(spark, sf):
    return geo_events(spark, sf).filter(
        geo.in_box(*lonlat(), R.BEIJING_BOX) & in_span(F.col("ts"), _WEEK)).select("fid", "ts", "lon", "lat")


@query("flt_all", "SELECT count(*) AS n FROM events")
def flt_all(spark, sf):
    return geo_events(spark, sf).agg(F.count("*").alias("n"))
