"""Feature tables derived from the given tables, in Spark and as SQL text for the check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from waymark.functions import geo
from waymark.functions.cells import unix_millis
from waymark.functions.times import TimeSpan
from waymark.operators.skew import lead_in_key
from waymark.operators.windows import WindowSet
from waymark.plans.regions import CITY_BUFFER_KM, SITES
from waymark.session import scratch_dir
from waymark.sources.extents import read_extents, write_extents

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _site(number: Column) -> Column:
    """Site struct by number: an array literal instead of a join with twelve rows."""
    sites = F.array(*[
        F.struct(F.lit(name).alias("city"), F.lit(lon).alias("lon"), F.lit(lat).alias("lat"))
        for _, name, lon, lat in SITES
    ])
    return F.element_at(sites, (number % 12 + 1).cast("int"))


def _mod_product(value: Column, factor: int, modulus: int) -> Column:
    # (value * factor) % modulus without overflow for large ids
    return (value % modulus) * (factor % modulus) % modulus


def _spread_points(df: DataFrame, key: str, site_by: str) -> DataFrame:
    dx = (_mod_product(F.col(key), 104729, 8001) - 4000).cast("double") / F.lit(1000.0)
    dy = (_mod_product(F.col(key), 15485863, 6007) - 3003).cast("double") / F.lit(1000.0)
    return (
        df.withColumn("_site", _site(F.col(site_by)))
        .withColumn("city", F.col("_site.city"))
        .withColumn("lon", F.col("_site.lon") + dx)
        .withColumn("lat", F.col("_site.lat") + dy)
        .drop("_site")
    )


def geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a time of day: fid, ts, user_id, event_type, value, city, lon, lat."""
    return as_points(table(spark, sf_dir, "events"))


def as_points(events: DataFrame) -> DataFrame:
    """The same columns for an events table or stream."""
    columns = events.select(F.col("event_id").alias("fid"), "ts", "user_id", "event_type", "value")
    return _spread_points(columns, "fid", "user_id")


def geo_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a midnight ``day``: fid, day, custkey, price, priority, city, lon, lat."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fid"), F.col("o_orderdate").alias("day"), F.col("o_custkey").alias("custkey"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    return _spread_points(orders, "fid", "custkey")


def geo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square extents with the corner at each order's point: fid, day, xmin, ymin, xmax, ymax."""
    width = ((F.col("fid") % 17) + 1).cast("double") / F.lit(4.0)
    return geo_orders(spark, sf_dir).select(
        "fid", "day", "city", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"),
        F.least(F.col("lon") + width, F.lit(180.0)).alias("xmax"),
        F.least(F.col("lat") + width, F.lit(90.0)).alias("ymax"))


# Corners of the outlines of polygon features, in widths from their lower left corner. An arrow head, a hole
# in its shaft and a second part beside it.
RING_SHAPES = {
    "outer": [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.25), (0.0, 1.0), (0.0, 0.0)],
    "hole": [(0.25, 0.0625), (0.5, 0.125), (0.75, 0.0625), (0.25, 0.0625)],
    "part": [(1.5, 0.5), (2.0, 0.5), (1.75, 1.0), (1.5, 0.5)],
}


def geo_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon features at each order's point: fid, day, city, custkey, rings. Every third has a hole, every fifth a second part."""
    width = (F.col("fid") % 17 + 1).cast("double") / F.lit(4.0)
    ring = lambda name: F.array(*[F.struct((F.col("lon") + width * F.lit(x)).alias("x"), (F.col("lat") + width * F.lit(y)).alias("y")) for x, y in RING_SHAPES[name]])
    none = F.array().cast(f"array<{geo.RING_TYPE}>")
    rings = F.concat(F.array(ring("outer")), F.when(F.col("fid") % 3 == 0, F.array(ring("hole"))).otherwise(none), F.when(F.col("fid") % 5 == 0, F.array(ring("part"))).otherwise(none))
    return geo_orders(spark, sf_dir).select("fid", "day", "city", "custkey", rings.alias("rings"))


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the day tracks of each user: track, t1, t2, fid1, x1, y1, x2, y2."""
    points = geo_events(spark, sf_dir).select("fid", "ts", "user_id", "lon", "lat").withColumn(
        "day", F.to_date("ts"))
    led = lead_in_key(points, ["user_id", "day"], ["ts", "fid"], ["ts", "fid", "lon", "lat"], "nxt")
    return led.filter(F.col("nxt").isNotNull()).select(
        F.concat_ws("-", F.col("user_id"), F.date_format("day", "yyyyMMdd")).alias("track"),
        F.col("fid").alias("fid1"), F.col("nxt.fid").alias("fid2"),
        F.col("ts").alias("t1"), F.col("nxt.ts").alias("t2"),
        F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.col("nxt.lon").alias("x2"), F.col("nxt.lat").alias("y2"))


def track_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, t_start of every day track with at least two points, straight from the points."""
    track = F.concat_ws("-", F.col("user_id"), F.date_format(F.to_date("ts"), "yyyyMMdd")).alias("track")
    return geo_events(spark, sf_dir).groupBy(track).agg(F.min("ts").alias("t_start"), F.count("*").alias("_n")).filter(
        F.col("_n") >= 2).drop("_n")


_stored: dict[tuple[str, str], tuple[str, StructType]] = {}


def segment_box() -> list[Column]:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return [F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)]


def store_tracks(spark: SparkSession, sf_dir: str) -> tuple[str, StructType]:
    """Segments with their track's begin and their length, written by cell and week once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        step = F.hypot(geo.merc_x(F.col("x2")) - geo.merc_x(F.col("x1")), geo.merc_y(F.col("y2")) - geo.merc_y(F.col("y1")))
        segments = track_segments(spark, sf_dir).join(track_times(spark, sf_dir), "track").withColumn("metres", step)
        path = scratch_dir(spark, "track-store")
        write_extents(segments, path, segment_box(), "t_start")
        _stored[key] = path, segments.schema
    return _stored[key]


def stored_segments(spark: SparkSession, sf_dir: str, asked: Sequence[float] | None = None, span: TimeSpan | None = None) -> DataFrame:
    """Stored segments that may meet a box in a span of track begins: track, fid1, fid2, t1, t2, x1, y1, x2, y2, t_start, metres."""
    path, schema = store_tracks(spark, sf_dir)
    return read_extents(spark, path, schema, segment_box(), asked, span)


def segments_for(spark: SparkSession, sf_dir: str, ws: WindowSet) -> DataFrame:
    return stored_segments(spark, sf_dir, ws.envelope, ws.span)


def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per track from its stored segments: track, t_start, n_points, metres."""
    return stored_segments(spark, sf_dir).groupBy("track").agg(
        F.min("t1").alias("t_start"), (F.count("*") + 1).alias("n_points"), F.sum("metres").alias("metres"))


# The period words of the buffer queries.
PERIOD_WORDS = ["FOURTEEN-MONTHS", "TEN-MONTHS", "six-MONTHS", "TWO-MONTHS", "TWO-WEEKS", "SIX-DAYS"]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query run and system, derived from orders."""
    k = F.col("o_orderkey")
    idx = F.floor(k / 2) % 4608
    name = F.concat(
        F.lit("GDELT-IN-CITY-BUFFERS-"), _pick(PERIOD_WORDS, F.floor(idx / 8)), F.lit("-"),
        (F.lit(2000) + F.floor(idx / 576)).cast("string"), F.lit("-"), _pick([s[1] for s in SITES], F.floor(idx / 48)),
        F.lit("-"), _pick(CITY_BUFFER_KM, idx).cast("string"), F.lit("-KM"),
        F.when(idx % 10 == 3, F.lit("-LOOSE")).otherwise(F.lit("")))
    start = unix_millis(F.col("o_orderdate")) + _mod_product(k, 997, 86400000)
    duration = F.floor("o_totalprice").cast("long") % 20000
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), k.cast("string")).alias("uuid"), name.alias("queryName"),
        F.when(k % 2 == 0, "A").otherwise("B").alias("system"),
        F.concat(F.lit("cluster-"), (k % 2 + 2 * (F.floor(k / 9216) % 2)).cast("string")).alias("clusterId"),
        start.alias("startTime"), (start + duration).alias("endTime"), duration.alias("duration"),
        (start + F.floor(duration / 4)).alias("timeAtFirstResult"),
        (idx * 7919 % 20011 + F.when((k % 2 == 1) & (F.floor(k / 2) % 97 == 0), 1).otherwise(0)).alias("result"),
        (k % 7 == 0).alias("test"))


# ---- the same as SQL -------------------------------------------------------------------------

_SITES_SQL = "sites(site_id, city, slon, slat) AS (VALUES " + ", ".join(
    f"({i}, '{n}', CAST({lon} AS DOUBLE), CAST({lat} AS DOUBLE))" for i, n, lon, lat in SITES) + ")"


def _points_sql(key: str) -> str:
    return (f"slon + CAST(({key}*104729)%8001 - 4000 AS DOUBLE)/1000e0 AS lon, "
            f"slat + CAST(({key}*15485863)%6007 - 3003 AS DOUBLE)/1000e0 AS lat")


_R = "6378137e0"


def mx_sql(lon: str) -> str:
    return f"({_R}*radians({lon}))"


def my_sql(lat: str) -> str:
    return f"({_R}*ln(tan(pi()/4e0+radians(greatest(-89.9999e0,least(89.9999e0,{lat})))/2e0)))"


def pick_sql(values: list, index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{items}], CAST(({index}) % {len(values)} AS INTEGER) + 1)"


CTES: dict[str, tuple[list[str], str]] = {
    "sites": ([], _SITES_SQL),
    "geo_events": (["sites"], "geo_events AS (SELECT e.event_id AS fid, e.ts, e.user_id, e.event_type, e.value, city, "
                   + _points_sql("e.event_id") + " FROM events e JOIN sites ON site_id = e.user_id % 12)"),
    "geo_orders": (["sites"], "geo_orders AS (SELECT o_orderkey AS fid, o_orderdate AS day, o_custkey AS custkey, "
                   "o_totalprice AS price, o_orderpriority AS priority, city, "
                   + _points_sql("o_orderkey") + " FROM orders JOIN sites ON site_id = o_custkey % 12)"),
    "geo_boxes": (["geo_orders"], "geo_boxes AS (SELECT fid, day, city, lon AS xmin, lat AS ymin, "
                  "least(lon + ((fid % 17) + 1)/4e0, 180e0) AS xmax, least(lat + ((fid % 17) + 1)/4e0, 90e0) AS ymax "
                  "FROM geo_orders)"),
    "ring_edges": (["geo_orders"], "ring_steps(number, every, x1, y1, x2, y2) AS (VALUES " + ", ".join(
        f"({n}, {every}, {a[0]!r}e0, {a[1]!r}e0, {b[0]!r}e0, {b[1]!r}e0)" for n, (ring, every) in enumerate(zip(RING_SHAPES.values(), (1, 3, 5)))
        for a, b in zip(ring, ring[1:])) + "), "
        "ring_sides AS (SELECT fid, day, lon + ((fid % 17) + 1)/4e0*r.x1 AS ax, lat + ((fid % 17) + 1)/4e0*r.y1 AS ay, lon + ((fid % 17) + 1)/4e0*r.x2 AS bx, "
        "lat + ((fid % 17) + 1)/4e0*r.y2 AS b_y FROM geo_orders JOIN ring_steps r ON fid % every = 0), "
        "ring_edges AS (SELECT fid, day, CASE WHEN ay <= b_y THEN ax ELSE bx END AS x1, least(ay, b_y) AS y1, CASE WHEN ay <= b_y THEN bx ELSE ax END AS x2, "
        "greatest(ay, b_y) AS y2 FROM ring_sides)"),
    "segs": (["geo_events"], "led AS (SELECT fid, ts, user_id, lon, lat, CAST(ts AS DATE) AS day, "
             "lead(fid) OVER w AS fid2, lead(ts) OVER w AS t2, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 "
             "FROM geo_events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, fid)), "
             "segs AS (SELECT user_id || '-' || strftime(day, '%Y%m%d') AS track, fid AS fid1, fid2, ts AS t1, t2, "
             "lon AS x1, lat AS y1, x2, y2 FROM led WHERE fid2 IS NOT NULL)"),
    "tracks": (["segs"], "tracks AS (SELECT track, min(t1) AS t_start, count(*) + 1 AS n_points, "
               f"sum(sqrt(pow({mx_sql('x2')}-{mx_sql('x1')},2) + pow({my_sql('y2')}-{my_sql('y1')},2))) AS metres "
               "FROM segs GROUP BY track)"),
    "runs": ([], "runs0 AS (SELECT *, o_orderkey AS k, (o_orderkey // 2) % 4608 AS idx, "
             "CAST(floor(o_totalprice) AS BIGINT) % 20000 AS dur, "
             "CAST(epoch_ms(o_orderdate) AS BIGINT) + (o_orderkey*997) % 86400000 AS st FROM orders), "
             "runs AS (SELECT 'run-' || k AS uuid, 'GDELT-IN-CITY-BUFFERS-' || "
             + pick_sql(PERIOD_WORDS, "idx // 8") + " || '-' || (2000 + idx // 576) || '-' || "
             + pick_sql([s[1] for s in SITES], "idx // 48") + " || '-' || " + pick_sql(CITY_BUFFER_KM, "idx")
             + " || '-KM' || CASE WHEN idx % 10 = 3 THEN '-LOOSE' ELSE '' END AS \"queryName\", "
             "CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS system, 'cluster-' || (k % 2 + 2 * (k // 9216 % 2)) AS \"clusterId\", "
             "st AS \"startTime\", st + dur AS \"endTime\", dur AS duration, st + dur // 4 AS \"timeAtFirstResult\", "
             "idx * 7919 % 20011 + CASE WHEN k % 2 = 1 AND (k // 2) % 97 = 0 THEN 1 ELSE 0 END AS result, "
             "k % 7 = 0 AS test FROM runs0)"),
}


def with_ctes(names: str, body: str, *extra: str) -> str:
    """``WITH`` the named fixtures (and what they need) and further CTE texts, then ``body``."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in seen:
            seen.append(name)

    for name in names.split():
        visit(name)
    parts = [CTES[n][1] for n in seen] + list(extra)
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
