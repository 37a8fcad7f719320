"""Polygon features against polygons, boxes and buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators.polygons import polygons_in_windows, rings_edges
from waymark.operators.windows import count_matches, window_set
from waymark.plans import presets as P, regions as R
from waymark.plans.fixtures import geo_rings, mx_sql, my_sql, with_ctes
from waymark.plans.q_filters import SEGMENT_HITS_SQL
from waymark.plans.registry import query
from waymark.plans.sqltext import shapes_cte, span_test, windows_cte
from waymark.session import scratch_dir
from waymark.sources import geojson


def _features(spark, sf):
    # an order of no customer has no site; compiled, Spark's element_at takes the last one for it
    return geo_rings(spark, sf).select("fid", "day", F.when(F.col("custkey").isNotNull(), rings_edges(F.col("rings"))).alias("edges"))


# Boundaries as segments, and vertices of the shapes in the features: an odd number of a feature's edges to their right.
_AS_SEGMENTS = "segs AS (SELECT fid AS track, row_number() OVER () AS fid1, x1, y1, x2, y2 FROM ring_edges)"
_IN_FEATURE = "((f.x2-f.x1)*(v.y-f.y1)-(v.x-f.x1)*(f.y2-f.y1))"
_AROUND = (
    "ring_boxes AS (SELECT fid, min(least(x1, x2)) AS xmin, min(y1) AS ymin, max(greatest(x1, x2)) AS xmax, max(y2) AS ymax FROM ring_edges GROUP BY fid), "
    "vertices AS ({vertices}), "
    "around AS (SELECT DISTINCT fid, geom_id FROM (SELECT b.fid, v.geom_id, v.x, v.y, "
    f"count(*) FILTER (WHERE v.y >= f.y1 AND v.y < f.y2 AND {_IN_FEATURE} > 0) % 2 = 1 "
    f"OR bool_or(v.y BETWEEN f.y1 AND f.y2 AND v.x BETWEEN least(f.x1,f.x2) AND greatest(f.x1,f.x2) AND {_IN_FEATURE} = 0) AS inside "
    "FROM ring_boxes b JOIN vertices v ON v.x BETWEEN b.xmin AND b.xmax AND v.y BETWEEN b.ymin AND b.ymax JOIN ring_edges f ON f.fid = b.fid GROUP BY b.fid, v.geom_id, v.x, v.y) WHERE inside)")
_HITS = "met AS (SELECT track AS fid, geom_id FROM track_hits UNION SELECT fid, geom_id FROM around)"
_MATCHES = f"SELECT h.fid, w.name FROM met h JOIN (SELECT DISTINCT fid, day FROM ring_edges) f ON f.fid = h.fid JOIN windows w ON w.geom_id = h.geom_id AND {span_test('f.day')}"

_BOX = P.box_shape("small-box", (2.5, 49.0, 2.50001, 49.00001))
_REGIONS = P.combine("RINGS", [*P.france_regions().items(), ("beijing", P.beijing()), ("center", P.beijing_center()), ("california", P.california()),
                               ("spot", P.polygon_shape("spot", [(2.4, 48.9), (2.40001, 48.9), (2.4, 48.90001), (2.4, 48.9)]))], P.month_periods([1996, 1997]))


def _polygon_sql(shapes, rows):
    return with_ctes("ring_edges", _MATCHES, windows_cte(rows), shapes_cte(shapes), _AS_SEGMENTS, SEGMENT_HITS_SQL,
                     _AROUND.format(vertices="SELECT DISTINCT geom_id, x1 AS x, y1 AS y FROM edges"), _HITS)


@query("flt_intersects_polygon_rings", _polygon_sql(*_REGIONS))
def flt_intersects_polygon_rings(spark, sf):
    return polygons_in_windows(_features(spark, sf), window_set(spark, *_REGIONS))


_ONE = ([P.beijing()], [P.WindowRow("RINGS-IN-BEIJING", P.beijing().geom_id)])


@query("flt_intersects_polygon_geojson", _polygon_sql(*_ONE))
def flt_intersects_polygon_geojson(spark, sf):
    """The same of features written as GeoJSON and read back; all rings are parts of one outline there."""
    path = scratch_dir(spark, "ring-features")
    coordinates = F.transform("rings", lambda ring: F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
                                 F.struct(F.col("fid").cast("string").alias("name")).alias("properties")))
    geo_rings(spark, sf).select(geojson.collection_json(feature).alias("value")).write.text(path)
    features = geojson.read_geojson(spark, path, "name", multiline=False).select(F.col("name").cast("bigint").alias("fid"), F.lit(None).cast("timestamp_ntz").alias("day"), "edges")
    return polygons_in_windows(features, window_set(spark, *_ONE))


_BOXES = P.combine("RINGS", [("small-box", _BOX), *[(f"{c}-{r}", P.box_shape(f"cell-{c}-{r}", b)) for c, r, b in P.grid(R.BEIJING_BOX, 6, 6)]], [("", P.ALL_TIME)])


@query("flt_bbox_rings", with_ctes(
    "ring_edges", _MATCHES, windows_cte(_BOXES[1]), shapes_cte(_BOXES[0]), _AS_SEGMENTS,
    "track_hits AS (SELECT DISTINCT s.track, g.geom_id FROM segs s JOIN shapes g ON least(s.x1,s.x2) <= g.xmax AND greatest(s.x1,s.x2) >= g.xmin AND "
    "least(s.y1,s.y2) <= g.ymax AND greatest(s.y1,s.y2) >= g.ymin AND least({0}) <= 0 AND greatest({0}) >= 0)".format(
        ", ".join(f"((s.x2-s.x1)*({y}-s.y1)-(s.y2-s.y1)*({x}-s.x1))" for x in ("g.xmin", "g.xmax") for y in ("g.ymin", "g.ymax"))),
    _AROUND.format(vertices="SELECT geom_id, xmin AS x, ymin AS y FROM shapes"), _HITS))
def flt_bbox_rings(spark, sf):
    return polygons_in_windows(_features(spark, sf), window_set(spark, *_BOXES))


# nearest point of a projected edge to the centre, or the centre in the feature
_NEAR = (
    "projected AS (SELECT fid, x1, y1, x2, y2, {ax} AS ax, {ay} AS ay, {bx} AS bx, {b_y} AS b_y FROM ring_edges), "
    "track_hits AS (SELECT DISTINCT fid AS track, geom_id FROM (SELECT *, ax + t * (bx - ax) - mx AS px, ay + t * (b_y - ay) - my AS py FROM (SELECT p.*, g.geom_id, g.mx, g.my, g.metres, "
    "CASE WHEN ax = bx AND ay = b_y THEN 0e0 ELSE greatest(0e0, least(1e0, ((mx - ax) * (bx - ax) + (my - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) END AS t "
    "FROM projected p JOIN shapes g ON least(x1,x2) <= g.xmax AND greatest(x1,x2) >= g.xmin AND least(y1,y2) <= g.ymax AND greatest(y1,y2) >= g.ymin)) WHERE px * px + py * py <= metres * metres)"
).format(ax=mx_sql("x1"), ay=my_sql("y1"), bx=mx_sql("x2"), b_y=my_sql("y2"))
_CENTRES = _AROUND.format(vertices="SELECT geom_id, degrees(mx/6378137e0) AS x, degrees(2e0*atan(exp(my/6378137e0)) - pi()/2e0) AS y FROM shapes")


def _buffer_sql(shapes, rows, body):
    return with_ctes("ring_edges", body, windows_cte(rows), shapes_cte(shapes), _NEAR, _CENTRES, _HITS)


_CITIES = P.combine("RINGS", [b for s in R.SITES for b in P.city_buffers(s[1])], P.month_periods([1997]))


@query("join_rings_buffers", _buffer_sql(*_CITIES, _MATCHES))
def join_rings_buffers(spark, sf):
    return polygons_in_windows(_features(spark, sf), window_set(spark, *_CITIES))


_VIENNA = P.free_buffers(2.35, 48.86)


@query("vienna_buffers_rings", _buffer_sql(*_VIENNA, "SELECT w.name, count(h.fid) AS n FROM windows w LEFT JOIN met h ON h.geom_id = w.geom_id GROUP BY w.name"))
def vienna_buffers_rings(spark, sf):
    """Polygon features within buffers of all sizes round a free point."""
    ws = window_set(spark, *_VIENNA)
    return count_matches(polygons_in_windows(_features(spark, sf), ws), ws)
