"""The named query sets over the derived feature tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from waymark.operators.tracks import timed_segments_in_windows, tracks_meeting_shapes
from waymark.operators.windows import (
    EVERYWHERE, WINDOW_SCHEMA, count_in_windows, count_matches, match_times, points_in_windows, window_set, window_set_from_tables,
)
from waymark.plans import presets as P, regions as R
from waymark.plans.fixtures import geo_boxes, geo_events, geo_orders, segments_for, stored_segments, table, with_ctes
from waymark.plans.q_filters import SEGMENT_HITS_SQL
from waymark.plans.registry import query
from waymark.plans.sqltext import count_windows_sql, hits_cte, num, shapes_cte, span_test, windows_cte

# the trajectory and event sets run over the orders' points (1995 to 2001)
YEAR = 1997


def _counted(name, preset, source="geo_orders", ts="day", mode="exact"):
    read = {"geo_orders": geo_orders, "geo_events": geo_events}[source]

    @query(name, count_windows_sql(source, *preset, time_col=ts, mode=mode))
    def run(spark, sf):
        return count_in_windows(read(spark, sf), window_set(spark, *preset), ts, mode=mode)
    return run


# per source: reader, number, amount and text columns
_COLUMNS = {"geo_orders": (geo_orders, "custkey", "price", "priority"), "geo_events": (geo_events, "user_id", "value", "event_type")}


def _iterated(name, preset, source="geo_orders", ts="day"):
    """Reads every column of every matching feature instead of only counting."""
    shapes, rows = preset
    read, number, amount, text = _COLUMNS[source]
    hit = "JOIN hits h ON h.fid = f.fid" if shapes else ""
    extra = [windows_cte(rows)] + ([shapes_cte(shapes), hits_cte(source)] if shapes else [])
    sql = with_ctes(
        source, f"SELECT w.name, count(*) AS n, CAST(sum(f.fid) AS BIGINT) AS fids, CAST(sum(f.{number}) AS BIGINT) AS numbers, "
        f"round(sum(f.{amount}), 2) AS amount, CAST(sum(length(f.{text}) + length(f.city)) AS BIGINT) AS chars, max(f.{ts}) AS last_time, "
        "round(avg(f.lon), 6) AS lon, round(avg(f.lat), 6) AS lat "
        f"FROM {source} f {hit} JOIN windows w ON {span_test('f.' + ts)} GROUP BY w.name", *extra)

    @query(name, sql)
    def run(spark, sf):
        return points_in_windows(read(spark, sf), window_set(spark, *preset), ts).groupBy("name").agg(
            F.count("*").alias("n"), F.sum("fid").alias("fids"), F.sum(number).alias("numbers"),
            F.round(F.sum(amount), 2).alias("amount"), F.sum(F.length(text) + F.length("city")).alias("chars"),
            F.max(ts).alias("last_time"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))
    return run


for _key, _area, _year, _month in [
    ("life_beijing", "BEIJING", None, None), ("life_center", "BEIJING-CENTER", None, None),
    ("life_2011", None, YEAR, None), ("life_aug2011", None, YEAR, 8),
    ("life_beijing_aug", "BEIJING", YEAR, 8), ("life_center_jan", "CENTER-BEIJING", YEAR, 1), ("life_center_bbox_feb", "CENTER-BEIJING-BBOX", YEAR, 2),
    # and with a time of day: those points all lie in January 2024
    ("life_beijing_hours", "BEIJING", 2024, 1),
]:
    _source = ("geo_events", "ts") if _year == 2024 else ("geo_orders", "day")
    _counted(f"{_key}_count", P.life(_area, _year, _month), *_source)
    _iterated(f"{_key}_iterate", P.life(_area, _year, _month, "ITERATE"), *_source)

_LIFE_BOX = ([P.beijing_box()], [P.WindowRow(
    "GEOLIFE-IN-BEIJING-BBOX-COUNT", "beijing-box", P.during("2024-01-08", "2024-01-15"))])
_counted("life_bbox", _LIFE_BOX, "geo_events", "ts")
_counted("life_bbox_count", P.life("BEIJING-BBOX"))
_counted("life_bbox_loose", P.life("BEIJING-BBOX", loose=True), mode="loose")
_iterated("life_bbox_iterate", P.life("BEIJING-BBOX", how="ITERATE"))
for _n in (2, 4, 8, 16, 32):
    _counted(f"life_tiles_{_n}", P.life_tiles(_n), "geo_events", "ts")

def _exact_and_loose(name, preset):
    """A query set and its loose form, which answers from the cells of each window's cover."""
    shapes, rows = preset
    _counted(name, preset)
    _counted(f"{name}_loose", (shapes, [replace(r, name=P.loose_name(r.name, True)) for r in rows]), mode="loose")


for _context in (None, "check"):
    _p = "cities" if _context else "gdelt"
    _exact_and_loose(f"{_p}_france_region_bbox_7d", P.france_region_bbox_7d(_context, 2001))
    _exact_and_loose(f"{_p}_france_bbox_6m", P.france_halves(True, context=_context))
    _exact_and_loose(f"{_p}_france_6m", P.france_halves(False, context=_context))
    _exact_and_loose(f"{_p}_france_bbox_1m", P.france_months(True, context=_context))
    _exact_and_loose(f"{_p}_france_1m", P.france_months(False, context=_context))
    for _key, _kind in [("2y", "TWO-YEARS"), ("1y", "ONE-YEAR"), ("10m", "TEN-MONTHS"), ("6m", "SIX-MONTHS"), ("3m", "THREE-MONTHS")]:
        _exact_and_loose(f"{_p}_regions_{_key}", P.france_by_region(_kind, YEAR, _context))
    for _key, _kind in [("14m", "FOURTEEN-MONTHS"), ("10m", "TEN-MONTHS"), ("6m", "six-MONTHS"), ("2m", "TWO-MONTHS"),
                        ("2w", "TWO-WEEKS"), ("6d", "SIX-DAYS")]:
        _exact_and_loose(f"{_p}_city_{_key}", P.city_windows(_kind, YEAR, [s[1] for s in R.SITES], context=_context))
    _exact_and_loose(f"{_p}_sa_3w", P.south_america_3w(YEAR, _context))


_SEG_BOX = ("least(s.x1,s.x2) <= g.xmax AND greatest(s.x1,s.x2) >= g.xmin AND "
            "least(s.y1,s.y2) <= g.ymax AND greatest(s.y1,s.y2) >= g.ymin")
_TURNS = ", ".join(f"((s.x2-s.x1)*({y}-s.y1)-(s.y2-s.y1)*({x}-s.x1))" for x in ("g.xmin", "g.xmax") for y in ("g.ymin", "g.ymax"))
# boxes: the segment's box overlaps and the corners are not all on one side
SEGMENT_BOX_HITS_SQL = (f"track_hits AS (SELECT DISTINCT s.track, g.geom_id FROM segs s JOIN shapes g ON {_SEG_BOX} "
                        f"AND least({_TURNS}) <= 0 AND greatest({_TURNS}) >= 0)")


def _tracked(name, preset):
    shapes, rows = preset
    track_hits = SEGMENT_HITS_SQL if shapes[0].edges else SEGMENT_BOX_HITS_SQL
    sql = with_ctes(
        "segs tracks", "SELECT w.name, coalesce(c.n, 0) AS n FROM windows w LEFT JOIN (SELECT w.name, count(*) AS n FROM track_hits h "
        f"JOIN tracks t ON t.track = h.track JOIN windows w ON w.geom_id = h.geom_id AND {span_test('t.t_start')} GROUP BY w.name) c "
        "ON c.name = w.name", windows_cte(rows), shapes_cte(shapes), track_hits)

    @query(name, sql)
    def run(spark, sf):
        ws = window_set(spark, *preset)
        return count_matches(timed_segments_in_windows(segments_for(spark, sf, ws), ws), ws)
    return run


_tracked("tracks_ca", P.tracks_california(False, None))
_tracked("tracks_ca_bbox", P.tracks_california(True, None))
_tracked("tracks_ca_7d", P.tracks_california(False, "7-DAY", 2024))
_tracked("tracks_ca_bbox_7d", P.tracks_california(True, "7-DAY", 2024))
_tracked("tracks_ca_1m", P.tracks_california(False, "1-MONTH", 2024))
_tracked("tracks_ca_bbox_1m", P.tracks_california(True, "1-MONTH", 2024))
_tracked("tracks_ca_months", P.tracks_california_months(2024))


for _key, _period, _levels in [("5d", "5DAY", [4, 5]), ("1w", "1WEEK", [4]), ("9d", "9DAY", [5]), ("18d", "18DAY", [3]),
                               ("27d", "27DAY", [6]), ("1m", "1MONTH", [4])]:
    _tracked(f"tracks_grid_{_key}", P.tracks_grid("grid", _period, _levels, range(2), 2024))


# ---- the whole pyramid: all eight levels, all indexes of all periods ------------------------------

_WEST, _SOUTH, _EAST, _NORTH = P.usa().box
_GRID_LEVELS = range(1, 9)
_GRID_ROWS = P.tracks_grid_spans(2024)


def pyramid_cells(spark):
    """``geom_id`` (level, column, row from the top) and box of every cell of the levels."""
    z = F.col("z")
    cols, rows = F.pow(F.lit(2.0), z), F.pow(F.lit(2.0), z - 1)
    numbers = spark.range(_GRID_LEVELS.start, _GRID_LEVELS.stop).withColumnRenamed("id", "z").withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), cols.cast("long") - 1))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), rows.cast("long") - 1)))
    x = lambda i: F.lit(_WEST) + F.lit(_EAST - _WEST) * i / cols
    y = lambda j: F.lit(_NORTH) - F.lit(_NORTH - _SOUTH) * j / rows
    return numbers.select(F.concat_ws("-", "z", "c", "r").alias("geom_id"), x(F.col("c")).alias("xmin"), y(F.col("r") + 1).alias("ymin"), x(F.col("c") + 1).alias("xmax"), y(F.col("r")).alias("ymax"))


@query("tracks_grid_full", with_ctes(
    "segs tracks", f"SELECT w.name, h.geom_id AS cell, count(*) AS n FROM track_hits h JOIN tracks t ON t.track = h.track JOIN windows w ON {span_test('t.t_start')} GROUP BY ALL",
    "numbers AS (SELECT z, c, UNNEST(range(CAST(pow(2, z - 1) AS BIGINT))) AS r FROM (SELECT z, UNNEST(range(CAST(pow(2, z) AS BIGINT))) AS c FROM range("
    f"{_GRID_LEVELS.start}, {_GRID_LEVELS.stop}) t(z))), "
    f"shapes AS (SELECT z || '-' || c || '-' || r AS geom_id, {num(_WEST)} + {num(_EAST - _WEST)}*c/pow(2e0, z) AS xmin, {num(_NORTH)} - {num(_NORTH - _SOUTH)}*(r+1)/pow(2e0, z-1) AS ymin, "
    f"{num(_WEST)} + {num(_EAST - _WEST)}*(c+1)/pow(2e0, z) AS xmax, {num(_NORTH)} - {num(_NORTH - _SOUTH)}*r/pow(2e0, z-1) AS ymax FROM numbers)",
    windows_cte(_GRID_ROWS), SEGMENT_BOX_HITS_SQL))
def tracks_grid_full(spark, sf):
    """Tracks per cell of all levels and per index of all periods, for the windows that have any.

    Cells are met once, then times: the nine million windows are never listed.
    """
    spans = window_set(spark, [], _GRID_ROWS)
    anytime = spark.createDataFrame([("all", EVERYWHERE, None, None, False)], WINDOW_SCHEMA)
    cells = window_set_from_tables(pyramid_cells(spark), anytime)
    segments = stored_segments(spark, sf, cells.envelope, spans.span)
    met = tracks_meeting_shapes(segments.select(F.struct("track", "t_start").alias("_t"), "x1", "y1", "x2", "y2"), cells, "_t")
    timed = met.select("_t.track", "_t.t_start", F.col("geom_id").alias("cell"), F.lit(EVERYWHERE).alias("geom_id"))
    return match_times(timed, spans, "t_start", "track").groupBy("name", "cell").agg(F.count("*").alias("n"))
