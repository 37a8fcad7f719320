"""Features against window tables, counts, and the window sets of the planner study."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import draws, geo
from waymark.functions.times import during
from waymark.operators.tracks import timed_segments_in_windows, tracks_meeting_shapes
from waymark.operators.windows import (
    count_extents_in_windows, count_in_windows, extents_in_windows, points_in_windows, selectivity, shape_test,
    window_set, window_set_from_tables,
)
from waymark.plans import presets as P, regions as R
from waymark.plans.fixtures import (
    geo_boxes, geo_events, geo_orders, mx_sql, my_sql, segments_for, table, with_ctes,
)
from waymark.plans.q_presets import SEGMENT_BOX_HITS_SQL
from waymark.plans.q_projections import _RANDOM_BOX_SQL, random_boxes
from waymark.plans.registry import query
from waymark.plans.sqltext import count_windows_sql, hits_cte, num, shapes_cte, span_test, stamp, windows_cte


def _rows(name, preset, source="geo_orders", ts="day"):
    shapes, rows = preset
    read = {"geo_events": geo_events, "geo_orders": geo_orders}[source]
    sql = with_ctes(source, f"SELECT f.fid, w.name FROM hits h JOIN {source} f ON f.fid = h.fid JOIN windows w ON w.geom_id = h.geom_id AND {span_test('f.' + ts)}",
                    windows_cte(rows), shapes_cte(shapes), hits_cte(source))

    @query(name, sql)
    def run(spark, sf):
        return points_in_windows(read(spark, sf), window_set(spark, *preset), ts).select("fid", "name")
    return run


_rows("join_points_in_windows", P.combine("JOIN", [*P.countries().items(), *P.france_regions().items()], P.month_periods(range(1995, 2002))))
_rows("join_buffers", P.city_windows("TEN-MONTHS", 1998, [s[1] for s in R.SITES]))
_rows("join_grid_cells", P.combine("GRID", [(f"{c}-{r}", P.box_shape(f"cell-{c}-{r}", b)) for c, r, b in P.grid(R.BEIJING_BOX, 10, 10)], [("", P.ALL_TIME)]),
      "geo_events", "ts")

_TRACK_JOIN = P.tracks_grid("JOIN", "1WEEK", [3], range(4), 2024)


@query("join_tracks_windows", with_ctes(
    "segs tracks", f"SELECT h.track, w.name FROM track_hits h JOIN tracks t ON t.track = h.track JOIN windows w ON w.geom_id = h.geom_id AND {span_test('t.t_start')}",
    windows_cte(_TRACK_JOIN[1]), shapes_cte(_TRACK_JOIN[0]), SEGMENT_BOX_HITS_SQL))
def join_tracks_windows(spark, sf):
    ws = window_set(spark, *_TRACK_JOIN)
    return timed_segments_in_windows(segments_for(spark, sf, ws), ws).select("track", "name")


# box features against polygons: an edge meets the box, or the box begins inside
_SHAPE_BOX = "f.xmin <= g.xmax AND f.xmax >= g.xmin AND f.ymin <= g.ymax AND f.ymax >= g.ymin"
_CORNER_TURNS = ", ".join(f"((e.x2-e.x1)*({y}-e.y1)-(e.y2-e.y1)*({x}-e.x1))" for x in ("f.xmin", "f.xmax") for y in ("f.ymin", "f.ymax"))
BOX_HITS_SQL = (
    "corners AS (SELECT fid, xmin AS lon, ymin AS lat FROM geo_boxes), " + hits_cte("corners")
    + f", box_hits AS (SELECT f.fid, g.geom_id FROM geo_boxes f JOIN shapes g ON {_SHAPE_BOX} JOIN edges e ON e.geom_id = g.geom_id WHERE "
    "least(e.x1,e.x2) <= f.xmax AND greatest(e.x1,e.x2) >= f.xmin AND e.y1 <= f.ymax AND e.y2 >= f.ymin "
    f"AND least({_CORNER_TURNS}) <= 0 AND greatest({_CORNER_TURNS}) >= 0 UNION SELECT fid, geom_id FROM hits)")
_POLYGON_FEATURES = P.combine("BOXES", P.france_regions().items(), P.month_periods([1996, 1997]))


@query("flt_intersects_polygon_features", with_ctes(
    "geo_boxes", f"SELECT h.fid, w.name FROM box_hits h JOIN geo_boxes f ON f.fid = h.fid JOIN windows w ON w.geom_id = h.geom_id AND {span_test('f.day')}",
    windows_cte(_POLYGON_FEATURES[1]), shapes_cte(_POLYGON_FEATURES[0]), BOX_HITS_SQL))
def flt_intersects_polygon_features(spark, sf):
    return extents_in_windows(geo_boxes(spark, sf), window_set(spark, *_POLYGON_FEATURES))


_BUFFERS = P.combine("BUFFER", [b for s in R.SITES for b in P.city_buffers(s[1])], [("", P.ALL_TIME)])
_CLOSE_X = f"greatest({mx_sql('f.xmin')}-g.mx, 0e0, g.mx-{mx_sql('f.xmax')})"
_CLOSE_Y = f"greatest({my_sql('f.ymin')}-g.my, 0e0, g.my-{my_sql('f.ymax')})"


@query("join_boxes_buffers", with_ctes(
    "geo_boxes", f"SELECT f.fid, w.name FROM geo_boxes f JOIN shapes g ON {_SHAPE_BOX} AND pow({_CLOSE_X}, 2) + pow({_CLOSE_Y}, 2) <= g.metres * g.metres "
    "JOIN windows w ON w.geom_id = g.geom_id", windows_cte(_BUFFERS[1]), shapes_cte(_BUFFERS[0])))
def join_boxes_buffers(spark, sf):
    return extents_in_windows(geo_boxes(spark, sf), window_set(spark, *_BUFFERS))


_PROJECTED = (f"SELECT track, x1, y1, x2, y2, {mx_sql('x1')} AS ax, {my_sql('y1')} AS ay, {mx_sql('x2')} AS bx, {my_sql('y2')} AS by_ FROM segs")


@query("join_tracks_buffers", with_ctes(
    "segs", "SELECT DISTINCT track, geom_id FROM (SELECT *, ax + t * (bx - ax) - mx AS px, ay + t * (by_ - ay) - my AS py FROM ("
    "SELECT p.*, g.geom_id, g.mx, g.my, g.metres, CASE WHEN ax = bx AND ay = by_ THEN 0e0 ELSE "
    "greatest(0e0, least(1e0, ((mx - ax) * (bx - ax) + (my - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) END AS t "
    f"FROM ({_PROJECTED}) p JOIN shapes g ON least(x1,x2) <= g.xmax AND greatest(x1,x2) >= g.xmin AND least(y1,y2) <= g.ymax AND greatest(y1,y2) >= g.ymin"
    ")) WHERE px * px + py * py <= metres * metres", shapes_cte(_BUFFERS[0])))
def join_tracks_buffers(spark, sf):
    ws = window_set(spark, *_BUFFERS)
    return tracks_meeting_shapes(segments_for(spark, sf, ws), ws)


# buffers round a free point, with box features
_FREE_POINT = (2.35, 48.86)
_FREE_NAME = "TRANS-VIENNA-BUFFERS-(2.35,48.86)-"
_FREE_DX = f"greatest({mx_sql('xmin')}-{num(geo.merc_xy(*_FREE_POINT)[0])}, 0e0, {num(geo.merc_xy(*_FREE_POINT)[0])}-{mx_sql('xmax')})"
_FREE_DY = f"greatest({my_sql('ymin')}-{num(geo.merc_xy(*_FREE_POINT)[1])}, 0e0, {num(geo.merc_xy(*_FREE_POINT)[1])}-{my_sql('ymax')})"


@query("vienna_buffers", with_ctes(
    "geo_boxes", f"SELECT '{_FREE_NAME}' || km || '-KM' AS name, count(*) FILTER (WHERE dx*dx+dy*dy <= km*1000e0*(km*1000e0)) AS n FROM "
    f"(SELECT {_FREE_DX} AS dx, {_FREE_DY} AS dy FROM geo_boxes), (VALUES {', '.join(f'({k})' for k in R.FREE_BUFFER_KM)}) b(km) GROUP BY km"))
def vienna_buffers(spark, sf):
    """One pass over the features counts all buffer sizes."""
    mx, my = (F.lit(v) for v in geo.merc_xy(*_FREE_POINT))
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    widest = geo_boxes(spark, sf).filter(geo.box_within_metres(box, mx, my, F.lit(max(R.FREE_BUFFER_KM) * 1000.0)))
    counts = widest.agg(*[F.count_if(geo.box_within_metres(box, mx, my, F.lit(k * 1000.0))).alias(f"k{k}") for k in R.FREE_BUFFER_KM])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(f"{_FREE_NAME}{k}-KM").alias("name"), F.col(f"k{k}").alias("n")) for k in R.FREE_BUFFER_KM])))


# ---- counts --------------------------------------------------------------------------------------

_COUNT = P.france_halves(False, range(1995, 2002))


@query("agg_count_exact", count_windows_sql("geo_orders", *_COUNT, time_col="day"))
def agg_count_exact(spark, sf):
    return count_in_windows(geo_orders(spark, sf), window_set(spark, *_COUNT), "day")


@query("agg_count_partial", count_windows_sql("geo_orders", *_COUNT, time_col="day"))
def agg_count_partial(spark, sf):
    """Counts of parts of the data added up per window."""
    ws = window_set(spark, *_COUNT)
    matches = points_in_windows(geo_orders(spark, sf), ws, "day")
    parts = matches.groupBy("name", F.to_date("day").alias("part")).agg(F.count("*").alias("c"))
    sums = parts.groupBy("name").agg(F.sum("c").alias("n"))
    return ws.windows.select("name").join(sums, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_count_iterate", with_ctes(
    "geo_orders", f"SELECT w.name, count(*) AS n, CAST(sum(f.fid) AS BIGINT) AS fids, round(sum(f.price), 2) AS price, CAST(sum(length(f.priority)) AS BIGINT) AS chars FROM hits h JOIN geo_orders f ON f.fid = h.fid "
    f"JOIN windows w ON w.geom_id = h.geom_id AND {span_test('f.day')} GROUP BY w.name", windows_cte(_COUNT[1]), shapes_cte(_COUNT[0]), hits_cte("geo_orders")))
def agg_count_iterate(spark, sf):
    return points_in_windows(geo_orders(spark, sf), window_set(spark, *_COUNT), "day").groupBy("name").agg(
        F.count("*").alias("n"), F.sum("fid").alias("fids"), F.round(F.sum("price"), 2).alias("price"),
        F.sum(F.length("priority")).alias("chars"))


_BJ = P.beijing()
_BOX_SQL = f"lon BETWEEN {num(_BJ.box[0])} AND {num(_BJ.box[2])} AND lat BETWEEN {num(_BJ.box[1])} AND {num(_BJ.box[3])}"


@query("agg_complement_check", with_ctes(
    "geo_events", f"SELECT count(*) AS everything, count(*) FILTER (WHERE {_BOX_SQL}) AS in_box, count(*) FILTER (WHERE NOT ({_BOX_SQL})) AS not_in_box, "
    "count(h.fid) AS in_polygon, count(*) - count(h.fid) AS not_in_polygon, 0 AS missing_box, 0 AS missing_polygon "
    "FROM geo_events e LEFT JOIN hits h ON h.fid = e.fid", shapes_cte([_BJ]), hits_cte("geo_events")))
def agg_complement_check(spark, sf):
    """All five counts and what is missing from inside plus outside, in one pass."""
    lon, lat = F.col("lon"), F.col("lat")
    in_box, in_polygon = geo.in_box(lon, lat, _BJ.box), shape_test(_BJ, lon, lat)
    counts = geo_events(spark, sf).select(in_box.alias("b"), in_polygon.alias("p")).agg(
        F.count("*").alias("everything"), F.count_if("b").alias("in_box"), F.count_if(~F.col("b")).alias("not_in_box"),
        F.count_if("p").alias("in_polygon"), F.count_if(~F.col("p")).alias("not_in_polygon"))
    return counts.withColumn("missing_box", (F.col("everything") - F.col("in_box") - F.col("not_in_box")).cast("int")).withColumn(
        "missing_polygon", (F.col("everything") - F.col("in_polygon") - F.col("not_in_polygon")).cast("int"))


# ---- random windows ------------------------------------------------------------------------------

_SPAN = during("2024-01-05", "2024-01-20")


def _random_windows(spark, boxes, span=None):
    name = F.col("name")
    geoms = boxes.select(name.alias("geom_id"), "xmin", "ymin", "xmax", "ymax")
    end = lambda v: F.lit(v.isoformat(sep=" ") if v else None).cast("timestamp_ntz")
    windows = boxes.select("name", name.alias("geom_id"), end(span.lo if span else None).alias("lo"),
                           end(span.hi if span else None).alias("hi"), F.lit(False).alias("closed"))
    return window_set_from_tables(geoms, windows)


def _supplier_boxes(spark, sf, width=20.0):
    return random_boxes(spark, sf, width).select(F.concat(F.lit("random-"), F.col("s_suppkey").cast("string")).alias("name"), "xmin", "ymin", "xmax", "ymax")


_IN_BOX = "e.lon BETWEEN b.xmin AND b.xmax AND e.lat BETWEEN b.ymin AND b.ymax"


@query("random_extents", with_ctes(
    "geo_events", f"SELECT 'random-' || s_suppkey AS name, count(e.fid) AS n FROM ({_RANDOM_BOX_SQL}) b LEFT JOIN geo_events e ON {_IN_BOX} GROUP BY 1"))
def random_extents(spark, sf):
    ws = _random_windows(spark, _supplier_boxes(spark, sf))
    return count_in_windows(geo_events(spark, sf), ws)


@query("random_extents_time", with_ctes(
    "geo_events", f"SELECT 'random-' || s_suppkey AS name, count(e.fid) AS n FROM ({_RANDOM_BOX_SQL}) b LEFT JOIN geo_events e ON {_IN_BOX} "
    f"AND e.ts > {stamp(_SPAN.lo)} AND e.ts < {stamp(_SPAN.hi)} GROUP BY 1"))
def random_extents_time(spark, sf):
    ws = _random_windows(spark, _supplier_boxes(spark, sf), _SPAN)
    return count_in_windows(geo_events(spark, sf), ws)


@query("random_points", with_ctes(
    "geo_boxes", "SELECT 'random-' || s_suppkey AS name, count(e.fid) AS n FROM "
    f"({_RANDOM_BOX_SQL}) b LEFT JOIN geo_boxes e ON e.xmin <= b.xmin AND e.xmax >= b.xmin AND e.ymin <= b.ymin AND e.ymax >= b.ymin GROUP BY 1"))
def random_points(spark, sf):
    """Random points without a width: box features that cover each."""
    ws = _random_windows(spark, _supplier_boxes(spark, sf, None))
    return count_extents_in_windows(geo_boxes(spark, sf), ws)


@query("random_extents_boxes", with_ctes(
    "geo_boxes", "SELECT 'random-' || s_suppkey AS name, count(e.fid) AS n FROM "
    f"({_RANDOM_BOX_SQL}) b LEFT JOIN geo_boxes e ON e.xmin <= b.xmax AND e.xmax >= b.xmin AND e.ymin <= b.ymax AND e.ymax >= b.ymin GROUP BY 1"))
def random_extents_boxes(spark, sf):
    """Random boxes over box features."""
    ws = _random_windows(spark, _supplier_boxes(spark, sf))
    return count_extents_in_windows(geo_boxes(spark, sf), ws)


_SERIES_SQL = (
    "series AS (SELECT 'w' || b || '-' || s_suppkey AS name, xmin, ymin, least(xmin + 360e0/pow(2e0, b), 180e0) AS xmax, least(ymin + 360e0/pow(2e0, b), 90e0) AS ymax FROM "
    "(SELECT s_suppkey, b, 360e0*" + draws.unit_sql("x", "x", "b", "s_suppkey").replace("'x|x'", "'6|x'") + "-180e0 AS xmin, 180e0*"
    + draws.unit_sql("y", "y", "b", "s_suppkey").replace("'y|y'", "'6|y'") + "-90e0 AS ymin FROM supplier, range(4, 31) r(b)))"
)


def _width_series(spark, sf):
    """Boxes of widths 360 / 2^b, drawn anew for each b."""
    key, b = F.col("s_suppkey"), F.col("b")
    rows = table(spark, sf, "supplier").select(key, F.explode(F.sequence(F.lit(4), F.lit(30)).cast("array<bigint>")).alias("b"))
    width = F.lit(360.0) / F.pow(F.lit(2.0), b)
    corner = rows.select(key, b, width.alias("w"), (360.0 * draws.unit(6, "x", b, key) - 180.0).alias("xmin"), (180.0 * draws.unit(6, "y", b, key) - 90.0).alias("ymin"))
    return corner.select(F.concat(F.lit("w"), b.cast("string"), F.lit("-"), key.cast("string")).alias("name"), "xmin", "ymin",
                         F.least(F.col("xmin") + F.col("w"), F.lit(180.0)).alias("xmax"), F.least(F.col("ymin") + F.col("w"), F.lit(90.0)).alias("ymax"))


@query("random_width_series", with_ctes(
    "geo_events", f"SELECT b.name, count(e.fid) AS n FROM series b LEFT JOIN geo_events e ON {_IN_BOX} GROUP BY 1", _SERIES_SQL))
def random_width_series(spark, sf):
    return count_in_windows(geo_events(spark, sf), _random_windows(spark, _width_series(spark, sf)))


def _pick_sql(values, stream):
    items = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{items}], CAST(floor({draws.unit_sql(13, stream, 'o_orderkey')}*{len(values)}e0) AS INTEGER) + 1)"


def _pick(values, stream):
    at = F.floor(draws.unit(13, stream, F.col("o_orderkey")) * float(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(str(v)) for v in values]), at)


_YEARS = list(range(2000, 2016))


@query("grid_param_space", f"SELECT o_orderkey, CASE WHEN {draws.unit_sql(13, 'kind', 'o_orderkey')} < 0.9e0 THEN "
       f"{_pick_sql([s[1] for s in R.SITES], 'city')} || '/' || {_pick_sql(R.CITY_BUFFER_KM, 'size')} || '/' || {_pick_sql(_YEARS, 'year')} || '/' || {_pick_sql(list(P.CITY_PERIODS), 'test')} "
       f"ELSE {_pick_sql(list(R.SOUTH_AMERICA), 'country')} || '/' || {_pick_sql(_YEARS, 'year')} END AS request FROM orders")
def grid_param_space(spark, sf):
    """A random request per row: a city, size, year and test, or a country and year."""
    city = F.concat_ws("/", _pick([s[1] for s in R.SITES], "city"), _pick(R.CITY_BUFFER_KM, "size"), _pick(_YEARS, "year"), _pick(list(P.CITY_PERIODS), "test"))
    land = F.concat_ws("/", _pick(list(R.SOUTH_AMERICA), "country"), _pick(_YEARS, "year"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(draws.unit(13, "kind", F.col("o_orderkey")) < 0.9, city).otherwise(land).alias("request"))


# ---- planner study -------------------------------------------------------------------------------

# sixteen years around those of the orders
_PLAN_YEARS = range(1987, 2003)
_PLAN = P.plan_cities(_PLAN_YEARS)


def _cells_sql(alias):
    n = f"pow(2e0, {alias}.lvl)"
    axis = lambda v, low, span: f"floor(({alias}.{v}+{low})/{span}*{n})"
    return (f"CAST(({axis('xmax', '180e0', '360e0')}-{axis('xmin', '180e0', '360e0')}+1)*({axis('ymax', '90e0', '180e0')}-{axis('ymin', '90e0', '180e0')}+1) AS BIGINT)")


def _selectivity_sql(source, ts, preset):
    shapes, rows = preset
    exact_box = f"f.lon BETWEEN s.xmin AND s.xmax AND f.lat BETWEEN s.ymin AND s.ymax"
    circle = f"(s.metres IS NULL OR pow({mx_sql('f.lon')}-s.mx,2)+pow({my_sql('f.lat')}-s.my,2) <= s.metres*s.metres)"
    return with_ctes(source, "SELECT w.name, c.cells, c.span, coalesce(k.candidates, 0) AS candidates, coalesce(k.matches, 0) AS matches, "
                     "CASE WHEN k.candidates > 0 THEN round((k.candidates-k.matches)/CAST(k.candidates AS DOUBLE), 6) ELSE 0e0 END AS extra FROM windows w "
                     f"JOIN (SELECT geom_id, {_cells_sql('s')} AS cells, {_cells_sql('s')}/pow(4e0, s.lvl) AS span FROM shapes s) c ON c.geom_id = w.geom_id LEFT JOIN "
                     f"(SELECT w.name, count(*) AS candidates, count(*) FILTER (WHERE {exact_box} AND {circle}) AS matches FROM hits h JOIN {source} f ON f.fid = h.fid "
                     f"JOIN shapes s ON s.geom_id = h.geom_id JOIN windows w ON w.geom_id = h.geom_id AND {span_test('f.' + ts)} GROUP BY w.name) k ON k.name = w.name",
                     windows_cte(rows), shapes_cte(shapes), hits_cte(source, "loose"))


def _selective(name, preset, source, ts):
    read = {"geo_events": geo_events, "geo_orders": geo_orders}[source]

    @query(name, _selectivity_sql(source, ts, preset))
    def run(spark, sf):
        return selectivity(read(spark, sf), window_set(spark, *preset), ts).withColumn("extra", F.round("extra", 6))
    return run


_selective("agg_selectivity", _PLAN, "geo_orders", "day")
_selective("plan_cql", ([P.beijing_box()], [P.WindowRow("free-filter", "beijing-box", during("2024-01-03", "2024-01-23"))]), "geo_events", "ts")


@query("plan_cities", count_windows_sql("geo_orders", *_PLAN, time_col="day"))
def plan_cities(spark, sf):
    return count_in_windows(geo_orders(spark, sf), window_set(spark, *_PLAN), "day")


_PLAN_SA = P.plan_countries(_PLAN_YEARS)


@query("plan_sa", count_windows_sql("geo_orders", *_PLAN_SA, time_col="day"))
def plan_sa(spark, sf):
    return count_in_windows(geo_orders(spark, sf), window_set(spark, *_PLAN_SA), "day")


@query("plan_loop", with_ctes(
    "geo_events", "SELECT name, count(e.fid) AS candidates, count(e.fid) FILTER (WHERE " + _IN_BOX + ") AS matches FROM "
    "(SELECT *, least(20, greatest(0, floor(log2(greatest(1e0, least(360e0/greatest(xmax-xmin, 1e-9), 180e0/greatest(ymax-ymin, 1e-9))*4))/2)*2)) AS lvl FROM series) b LEFT JOIN geo_events e ON "
    "floor((e.lon+180e0)/360e0*pow(2e0,lvl)) BETWEEN floor((b.xmin+180e0)/360e0*pow(2e0,lvl)) AND least(floor((b.xmax+180e0)/360e0*pow(2e0,lvl)), pow(2e0,lvl)-1) AND "
    "floor((e.lat+90e0)/180e0*pow(2e0,lvl)) BETWEEN floor((b.ymin+90e0)/180e0*pow(2e0,lvl)) AND least(floor((b.ymax+90e0)/180e0*pow(2e0,lvl)), pow(2e0,lvl)-1) GROUP BY name", _SERIES_SQL))
def plan_loop(spark, sf):
    """Random boxes of halving widths: rows in their cover and rows that match."""
    ws = _random_windows(spark, _width_series(spark, sf))
    return selectivity(geo_events(spark, sf), ws).select("name", "candidates", "matches")
