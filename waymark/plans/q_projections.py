"""Column mappings, draws, projections, layout keys and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.functions import cells, draws, geo, labels
from waymark.functions.parse import concat, literal, to_date, to_double, to_int, to_point
from waymark.functions.times import during
from waymark.operators.results import numbered_pairs
from waymark.operators.windows import WindowRow, count_in_windows, points_in_windows, window_set
from waymark.plans import presets as P, regions as R
from waymark.plans.fixtures import (
    geo_boxes, geo_events, geo_orders, mx_sql, my_sql, run_results, table, with_ctes,
)
from waymark.plans.registry import query
from waymark.plans.sqltext import count_windows_sql, hits_cte, num, shapes_cte
from waymark.sources.delimited import map_columns
from waymark.sources.layout import round_robin_shard, shard


# ---- column mapping ------------------------------------------------------------------------------

@query("map_columns", with_ctes(
    "geo_events", "SELECT CAST(fid AS INTEGER) AS id, event_type || '@' || city AS what, lon, lat, 'events' AS kind, "
    "CAST(NULL AS VARCHAR) AS past_the_end FROM geo_events"))
def map_columns_query(spark, sf):
    lines = geo_events(spark, sf).select(F.concat_ws(",", "fid", "event_type", "city", "lon", "lat", F.lit("")).alias("value"))
    return map_columns(lines, {
        "id": lambda f: to_int(f[1]), "what": lambda f: concat(f[2], literal("@"), f[3]), "geom": lambda f: to_point(f[4], f[5]),
        "kind": lambda f: literal("events"), "past_the_end": lambda f: f[9],
    }, ",").select("id", "what", "geom.lon", "geom.lat", "kind", "past_the_end")


def _digits():
    return F.substring("props", 7, 2)  # two digits, or one digit and a brace


@query("fn_int", "SELECT event_id, coalesce(try_cast(substr(props, 7, 2) AS INTEGER), -2147483648) AS v FROM events")
def fn_int(spark, sf):
    return table(spark, sf, "events").select("event_id", to_int(_digits(), "sentinel").alias("v"))


@query("fn_double", "SELECT event_id, coalesce(try_cast(substr(props, 7, 2) AS DOUBLE), -1e0) AS v, "
                    "try_cast(substr(props, 7, 2) AS DOUBLE) IS NULL AS bad FROM events")
def fn_double(spark, sf):
    v = to_double(_digits(), "sentinel")
    return table(spark, sf, "events").select("event_id", F.nanvl(v, F.lit(-1.0)).alias("v"), F.isnan(v).alias("bad"))


@query("fn_concat", "SELECT event_id, event_type || '-' || props AS v FROM events")
def fn_concat(spark, sf):
    return table(spark, sf, "events").select("event_id", concat(F.col("event_type"), F.lit("-"), F.col("props")).alias("v"))


@query("fn_point", "SELECT event_id, CASE WHEN try_cast(substr(props, 7, 2) AS DOUBLE) IS NULL THEN 0e0 ELSE try_cast(substr(props, 7, 2) AS DOUBLE) END AS lon, "
                   "CASE WHEN try_cast(substr(props, 7, 2) AS DOUBLE) IS NULL THEN 0e0 ELSE value END AS lat FROM events")
def fn_point(spark, sf):
    p = to_point(_digits(), F.col("value").cast("string"), "sentinel")
    return table(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", "p.*")


@query("fn_date", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '1969-12-31 23:59:59.999' ELSE date_trunc('second', ts) END AS v FROM events")
def fn_date(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "2024-13-01 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", to_date(text, "yyyy-MM-dd HH:mm:ss", "sentinel").alias("v"))


@query("fn_literal", "SELECT event_id, 'gps' AS v FROM events")
def fn_literal(spark, sf):
    return table(spark, sf, "events").select("event_id", literal("gps").alias("v"))


# ---- draws ---------------------------------------------------------------------------------------

def _customer_draw(name, description, sql):
    @query(name, f"SELECT c_custkey, {sql} AS v FROM customer")
    def run(spark, sf):
        v = draws.draw(description, 42, name, F.col("c_custkey"))
        return table(spark, sf, "customer").select("c_custkey", F.round(v, 6).alias("v"))
    return run


_customer_draw("gen_uniform", ("uniform", -180, 180), f"round(-180e0 + {draws.unit_sql(42, 'gen_uniform', 'c_custkey')}*360e0, 6)")
_customer_draw("gen_normal", ("normal", 10, 2), f"round(10e0 + {draws.normal_sql(42, 'gen_normal', 'c_custkey')}*2e0, 6)")
_customer_draw("gen_fixed", ("fixed", 2.5), "2.5e0")


@query("gen_time", f"SELECT c_custkey, epoch_ms(CAST(floor(1e12 + {draws.unit_sql(1, 'time', 'c_custkey')}*(2e12-1e12)) AS BIGINT)) AS v FROM customer")
def gen_time(spark, sf):
    millis = F.floor(draws.draw(("uniform", 1e12, 2e12), 1, "time", F.col("c_custkey")))
    return table(spark, sf, "customer").select("c_custkey", F.timestamp_millis(millis).cast("timestamp_ntz").alias("v"))


@query("gen_attributes", "SELECT c_custkey, " + ", ".join(
    f"{draws.letters_sql(3, w, n, 'c_custkey')} AS {w}" for w, n in (("who", 3), ("what", 7), ("why", 13))) + " FROM customer")
def gen_attributes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", *[
        draws.letters(3, w, n, F.col("c_custkey")).alias(w) for w, n in (("who", 3), ("what", 7), ("why", 13))])


_BOX_WIDTH = 20.0
_RANDOM_BOX_SQL = (
    f"SELECT s_suppkey, xmin, ymin, least(xmin + {_BOX_WIDTH}e0, 180e0) AS xmax, least(ymin + {_BOX_WIDTH}e0, 90e0) AS ymax FROM "
    f"(SELECT s_suppkey, 360e0*{draws.unit_sql(5, 'x', 's_suppkey')}-180e0 AS xmin, 180e0*{draws.unit_sql(5, 'y', 's_suppkey')}-90e0 AS ymin FROM supplier)"
)


def random_boxes(spark, sf, width: float | None = _BOX_WIDTH):
    """A random box per supplier; no width makes it a point."""
    key = F.col("s_suppkey")
    corner = table(spark, sf, "supplier").select(
        key, (360.0 * draws.unit(5, "x", key) - 180.0).alias("xmin"), (180.0 * draws.unit(5, "y", key) - 90.0).alias("ymin"))
    return corner.withColumn("xmax", F.least(F.col("xmin") + F.lit(float(width or 0)), F.lit(180.0))).withColumn(
        "ymax", F.least(F.col("ymin") + F.lit(float(width or 0)), F.lit(90.0)))


@query("prj_random_box", f"SELECT s_suppkey, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM ({_RANDOM_BOX_SQL})")
def prj_random_box(spark, sf):
    return random_boxes(spark, sf).select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


# ---- geometry ------------------------------------------------------------------------------------

@query("prj_reproject", with_ctes(
    "geo_events", f"SELECT fid, round({mx_sql('lon')}, 3) AS x, round({my_sql('lat')}, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat, "
    "round(lon, 6) AS same FROM geo_events"))
def prj_reproject(spark, sf):
    events = geo_events(spark, sf)
    x, y = geo.reproject_point(F.col("lon"), F.col("lat"), 4326, 3857)
    same, _ = geo.reproject_point(F.col("lon"), F.col("lat"), None, 3857)
    moved = events.select("fid", x.alias("x"), y.alias("y"), same.alias("same"))
    lon, lat = geo.reproject_point(F.col("x"), F.col("y"), 3857, 4326)
    return moved.select("fid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"),
                        F.round(lat, 6).alias("lat"), F.round("same", 6).alias("same"))


def translated(df, origin: tuple[float, float], targets: list[tuple[str, float, float]]):
    """A copy of every feature per target, shifted by target minus origin."""
    shifts = F.array(*[
        F.struct(F.lit(n).alias("target"), F.lit(x - origin[0]).alias("dx"), F.lit(y - origin[1]).alias("dy")) for n, x, y in targets])
    return df.select("*", F.inline(shifts)).withColumn("lon", F.col("lon") + F.col("dx")).withColumn("lat", F.col("lat") + F.col("dy")).drop("dx", "dy")


_TARGETS = [(s[1], s[2], s[3]) for s in R.SITES[:4]]
_ORIGIN = (116.41, 39.9)
_TARGET_SQL = "targets(target, dx, dy) AS (VALUES " + ", ".join(
    f"('{n}', {num(x - _ORIGIN[0])}, {num(y - _ORIGIN[1])})" for n, x, y in _TARGETS) + ")"


@query("prj_translate", with_ctes(
    "geo_events", "SELECT fid, target, round(lon + dx, 6) AS lon, round(lat + dy, 6) AS lat FROM geo_events, targets", _TARGET_SQL))
def prj_translate(spark, sf):
    return translated(geo_events(spark, sf), _ORIGIN, _TARGETS).select(
        "fid", "target", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("join_replicate", with_ctes(
    "geo_boxes", "SELECT target, count(*) AS n, round(min(xmin + dx), 6) AS xmin, round(max(ymax + dy), 6) AS ymax FROM geo_boxes, targets GROUP BY target", _TARGET_SQL))
def join_replicate(spark, sf):
    """The same for rings: boxes as point arrays shifted to every target."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    shifts = F.array(*[F.struct(F.lit(n).alias("target"), F.lit(x - _ORIGIN[0]).alias("dx"), F.lit(y - _ORIGIN[1]).alias("dy")) for n, x, y in _TARGETS])
    copies = geo_boxes(spark, sf).select(ring.alias("ring"), F.inline(shifts))
    boxes = copies.select("target", geo.envelope(geo.translate_ring(F.col("ring"), F.col("dx"), F.col("dy"))).alias("b"))
    return boxes.groupBy("target").agg(F.count("*").alias("n"), F.round(F.min("b.xmin"), 6).alias("xmin"), F.round(F.max("b.ymax"), 6).alias("ymax"))


@query("prj_retype", with_ctes("geo_orders", "SELECT 'renamed' AS type_name, fid FROM geo_orders"))
def prj_retype(spark, sf):
    typed = geo_orders(spark, sf).withColumn("type_name", F.lit("orders"))
    return typed.withColumn("type_name", F.lit("renamed")).select("type_name", "fid")


@query("prj_envelope", with_ctes("geo_boxes", "SELECT fid, least(xmin, xmax - 9e0) AS xmin, ymin, xmax, greatest(ymax, ymin + 1.5e0) AS ymax FROM geo_boxes"))
def prj_envelope(spark, sf):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    line = F.array(pt(x1 - 9.0, y0 + 1.5), pt(x0, y0), pt(x1, y1))
    return geo_boxes(spark, sf).select("fid", geo.envelope(line).alias("b")).select("fid", "b.*")


_PARIS = P.combine("PARIS", P.paris_buffers(), [("", P.ALL_TIME)])
_RINGS = P.city_windows("six-MONTHS", 1997, ["Paris", "Beijing"], mode="ring")
_ALL_BUFFERS = P.combine("BUFFER", [b for s in R.SITES for b in P.city_buffers(s[1])], [("", P.ALL_TIME)])
_FREE = P.free_buffers(2.35, 48.86)


def _counted(name, preset, source, ts):
    read = {"geo_events": geo_events, "geo_orders": geo_orders}[source]

    @query(name, count_windows_sql(source, *preset, time_col=ts))
    def run(spark, sf):
        return count_in_windows(read(spark, sf), window_set(spark, *preset), ts)
    return run


_counted("prj_buffer", _PARIS, "geo_orders", "day")
_counted("prj_buffer_ring", _RINGS, "geo_orders", "day")
_counted("prj_buffer_set", _ALL_BUFFERS, "geo_events", "ts")
_counted("vienna_points", _FREE, "geo_orders", "day")


_GRID_BOX = P.usa().box
_GRID_SQL = (f"SELECT col, row, count(*) AS n FROM (SELECT CAST(floor((lon-({_GRID_BOX[0]!r}e0))/(({_GRID_BOX[2]!r}e0)-({_GRID_BOX[0]!r}e0))*16e0) AS BIGINT) AS col, "
             f"CAST(floor((({_GRID_BOX[3]!r}e0)-lat)/(({_GRID_BOX[3]!r}e0)-({_GRID_BOX[1]!r}e0))*8e0) AS BIGINT) AS row FROM geo_events "
             f"WHERE lon >= {_GRID_BOX[0]!r}e0 AND lon < {_GRID_BOX[2]!r}e0 AND lat > {_GRID_BOX[1]!r}e0 AND lat <= {_GRID_BOX[3]!r}e0) GROUP BY col, row")


def grid_cell(lon, lat, box, cols: int, rows: int):
    """Column and row of a point inside a box, row 0 at the top."""
    xmin, ymin, xmax, ymax = (float(v) for v in box)
    return (F.floor((lon - xmin) / (F.lit(xmax) - xmin) * float(cols)), F.floor((F.lit(ymax) - lat) / (F.lit(ymax) - ymin) * float(rows)))


@query("prj_grid", with_ctes("geo_events", _GRID_SQL))
def prj_grid(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    xmin, ymin, xmax, ymax = _GRID_BOX
    col, row = grid_cell(lon, lat, _GRID_BOX, 16, 8)
    inside = geo_events(spark, sf).filter((lon >= xmin) & (lon < xmax) & (lat > ymin) & (lat <= ymax))
    return inside.groupBy(col.alias("col"), row.alias("row")).agg(F.count("*").alias("n"))


@query("prj_pyramid", with_ctes(
    "geo_events", f"SELECT level, CAST(floor((lon-({_GRID_BOX[0]!r}e0))/(({_GRID_BOX[2]!r}e0)-({_GRID_BOX[0]!r}e0))*pow(2e0, level)) AS BIGINT) AS col, "
    f"CAST(floor((({_GRID_BOX[3]!r}e0)-lat)/(({_GRID_BOX[3]!r}e0)-({_GRID_BOX[1]!r}e0))*pow(2e0, level-1)) AS BIGINT) AS row, count(*) AS n FROM geo_events, range(1, 9) r(level) "
    f"WHERE lon >= {_GRID_BOX[0]!r}e0 AND lon < {_GRID_BOX[2]!r}e0 AND lat > {_GRID_BOX[1]!r}e0 AND lat <= {_GRID_BOX[3]!r}e0 GROUP BY ALL"))
def prj_pyramid(spark, sf):
    """Counts per cell of eight levels: the finest level is counted from the features, the others from it."""
    lon, lat = F.col("lon"), F.col("lat")
    xmin, ymin, xmax, ymax = _GRID_BOX
    col, row = grid_cell(lon, lat, _GRID_BOX, 2**8, 2**7)
    inside = geo_events(spark, sf).filter((lon >= xmin) & (lon < xmax) & (lat > ymin) & (lat <= ymax))
    finest = inside.groupBy(col.alias("c"), row.alias("r")).agg(F.count("*").alias("n"))
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(8)).cast("array<bigint>")))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(8) - F.col("level")))
    return levels.groupBy("level", up("c").alias("col"), up("r").alias("row")).agg(F.sum("n").alias("n"))


_REGIONS = P.combine("REGION", P.france_regions().items(), [("", P.ALL_TIME)])


@query("prj_union_geometry", with_ctes("geo_orders", "SELECT DISTINCT fid FROM hits", shapes_cte(_REGIONS[0]), hits_cte("geo_orders")))
def prj_union_geometry(spark, sf):
    """Membership in the union of all regions: in any of them, once."""
    return points_in_windows(geo_orders(spark, sf), window_set(spark, *_REGIONS), "day").select("fid").distinct()


# ---- layout keys ---------------------------------------------------------------------------------

def _spread_ctes(source, columns, steps):
    """A CTE per step, so that the text stays short."""
    out, prev = [], source
    for i, (shift, mask) in enumerate(steps):
        cols = ", ".join(f"(({c} | ({c} << {shift})) & {mask}) AS {c}" for c in columns)
        out.append(f"s{i} AS (SELECT fid, {cols} FROM {prev})")
        prev = f"s{i}"
    return out, prev


_Z2_CTES, _Z2 = _spread_ctes("base", ["cx", "cy"], cells.SPREAD_BY_2)
_Z3_CTES, _Z3 = _spread_ctes("base", ["cx", "cy", "ct"], cells.SPREAD_BY_3)


@query("lay_z2", with_ctes(
    "geo_events", f"SELECT fid, cx | (cy << 1) AS z FROM {_Z2}",
    "base AS (SELECT fid, CAST(floor((lon+180e0)/360e0*pow(2e0,31)) AS BIGINT) AS cx, CAST(floor((lat+90e0)/180e0*pow(2e0,31)) AS BIGINT) AS cy FROM geo_events)", *_Z2_CTES))
def lay_z2(spark, sf):
    return geo_events(spark, sf).select("fid", cells.z2(F.col("lon"), F.col("lat")).alias("z"))


@query("lay_z3", with_ctes(
    "geo_events", f"SELECT fid, CAST(cx | (cy << 1) | (ct << 2) AS BIGINT) AS z FROM {_Z3}",
    "base AS (SELECT fid, CAST(floor((lon+180e0)/360e0*pow(2e0,21)) AS HUGEINT) AS cx, CAST(floor((lat+90e0)/180e0*pow(2e0,21)) AS HUGEINT) AS cy, "
    "CAST(CAST(floor(epoch(ts)) AS BIGINT) % 604800 AS HUGEINT) AS ct FROM geo_events)", *_Z3_CTES))
def lay_z3(spark, sf):
    return geo_events(spark, sf).select("fid", cells.z3(F.col("lon"), F.col("lat"), F.col("ts"), "week").alias("z"))


@query("lay_period", with_ctes(
    "geo_orders", "SELECT fid, CAST(floor(epoch(day)/86400) AS BIGINT) AS d, CAST(floor(epoch(day)/604800) AS BIGINT) AS w, "
    "(extract(year FROM day)-1970)*12+extract(month FROM day)-1 AS m, extract(year FROM day)-1970 AS y FROM geo_orders"))
def lay_period(spark, sf):
    day = F.col("day")
    return geo_orders(spark, sf).select("fid", *[
        cells.period_number(day, p).alias(p[0]) for p in ("day", "week", "month", "year")])


@query("lay_shard", with_ctes(
    "geo_events", "SELECT CAST(CAST('0x' || substr(md5(CAST(fid AS VARCHAR)), 1, 13) AS BIGINT) % 8 AS INTEGER) AS shard, count(*) AS n, CAST(sum(fid) AS BIGINT) AS fids FROM geo_events GROUP BY 1"))
def lay_shard(spark, sf):
    return geo_events(spark, sf).groupBy(shard(F.col("fid"), 8).alias("shard")).agg(F.count("*").alias("n"), F.sum("fid").alias("fids"))


@query("lay_shard_robin")
def lay_shard_robin(spark, sf):
    """Shards by position in a task's input, which SQL does not know."""
    return geo_events(spark, sf).groupBy(round_robin_shard(8).alias("shard")).agg(F.count("*").alias("n"))


# ---- labels --------------------------------------------------------------------------------------

def _case_sql(name, values):
    return "CASE " + " ".join(f"WHEN contains(upper({name}), '{w}') THEN {v}" for w, v in values.items()) + " END"


_DAYS_SQL = _case_sql('"queryName"', labels.DAYS_OF_WORDS)
_SIZE_SQL = _case_sql('"queryName"', {f"{s}-KM": s for s in labels.SIZES_KM})


def _label_query(name, column, sql):
    @query(name, with_ctes("runs", f'SELECT uuid, {sql} AS v FROM runs'))
    def run(spark, sf):
        return run_results(spark, sf).select("uuid", column(F.col("queryName")).alias("v"))
    return run


_label_query("lbl_days", labels.days, _DAYS_SQL)
_label_query("lbl_time_desc", labels.time_words, _case_sql('"queryName"', {w: f"'{w}'" for w in labels.DAYS_OF_WORDS}))
_label_query("lbl_size", labels.size_km, _SIZE_SQL)


@query("lbl_group", with_ctes("runs", f"SELECT uuid, size, days, dense_rank() OVER (ORDER BY size, days) - 1 AS \"group\" FROM (SELECT uuid, {_SIZE_SQL} AS size, {_DAYS_SQL} AS days FROM runs)"))
def lbl_group(spark, sf):
    labelled = run_results(spark, sf).select("uuid", labels.size_km(F.col("queryName")).alias("size"), labels.days(F.col("queryName")).alias("days"))
    return numbered_pairs(labelled, ["size", "days"]).select("uuid", "size", "days", "group")


_GRID_NAME_SQL = ("'TRACKS-USA-GRID-TEST-' || list_extract(['5DAY','1WEEK','9DAY','18DAY','27DAY','1MONTH'], CAST(o_orderkey % 6 AS INTEGER) + 1) || '-' || (o_orderkey % 11) "
                  "|| '-' || (o_orderkey % 5 + 3) || '-' || (o_orderkey % 13) || '-' || (o_orderkey % 7)")


@query("lbl_track_time", f"SELECT o_orderkey, {_case_sql('name', labels.TRACK_DAYS)} AS v FROM (SELECT o_orderkey, {_GRID_NAME_SQL} AS name FROM orders)")
def lbl_track_time(spark, sf):
    return _grid_names(spark, sf).select("o_orderkey", labels.track_days(F.col("name")).alias("v"))


@query("lbl_zoom", "SELECT o_orderkey, CAST(o_orderkey % 5 + 3 AS INTEGER) AS v FROM orders")
def lbl_zoom(spark, sf):
    return _grid_names(spark, sf).select("o_orderkey", labels.zoom(F.col("name")).alias("v"))


def _grid_names(spark, sf):
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*[F.lit(w) for w in labels.TRACK_DAYS]), (k % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select(k, F.concat_ws("-", F.lit("TRACKS-USA-GRID-TEST"), word, k % 11, k % 5 + 3, k % 13, k % 7).alias("name"))


_SA = list(R.SOUTH_AMERICA)


def _sa_names(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    land = F.element_at(F.array(*[F.lit(c) for c in _SA]), (k % len(_SA) + 1).cast("int"))
    return table(spark, sf, "orders").select(k, F.concat_ws(
        "-", F.lit("GDELT-IN-SOUTH-AMERICA-COUNTRIES-THREE-WEEKS"), F.date_format(day, "yyyy"), F.upper(F.date_format(day, "MMM")), land).alias("name"))


_SA_LAND = "list_extract([" + ", ".join(f"'{c}'" for c in _SA) + f"], CAST(o_orderkey % {len(_SA)} AS INTEGER) + 1)"


@query("lbl_month", "SELECT o_orderkey, upper(strftime(o_orderdate, '%b')) AS v FROM orders")
def lbl_month(spark, sf):
    return _sa_names(spark, sf).select("o_orderkey", labels.month(F.col("name")).alias("v"))


@query("lbl_country", f"SELECT o_orderkey, upper({_SA_LAND}) AS v FROM orders")
def lbl_country(spark, sf):
    return _sa_names(spark, sf).select("o_orderkey", labels.country(F.col("name")).alias("v"))


@query("lbl_year", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS v FROM orders")
def lbl_year(spark, sf):
    return _sa_names(spark, sf).select("o_orderkey", labels.year(F.col("name")).alias("v"))


@query("lbl_loose", "SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '-LOOSE' ELSE '' END AS v FROM orders")
def lbl_loose(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", labels.loose_suffix(F.col("o_orderpriority"), F.col("o_orderkey") % 3 == 0).alias("v"))


@query("fld_ttfr", with_ctes("runs", 'SELECT uuid, "timeAtFirstResult" - "startTime" AS ttfr, "endTime" - "timeAtFirstResult" AS remaining FROM runs'))
def fld_ttfr(spark, sf):
    return run_results(spark, sf).select("uuid", labels.first_result_delay().alias("ttfr"), labels.remaining_time().alias("remaining"))


@query("fld_select_rename", with_ctes("runs", 'SELECT "queryName", duration AS a_duration, result FROM runs WHERE system = \'A\''))
def fld_select_rename(spark, sf):
    return run_results(spark, sf).filter("system = 'A'").select("queryName", "duration", "result").withColumnRenamed("duration", "a_duration")
