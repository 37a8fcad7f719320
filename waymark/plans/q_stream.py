"""Streams over the given events, drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators.windows import window_set
from waymark.plans import presets as P
from waymark.plans.fixtures import as_points, table, with_ctes
from waymark.plans.registry import query
from waymark.plans.sqltext import hits_cte, shapes_cte, span_test, windows_cte
from waymark.session import scratch_dir
from waymark.streaming import jobs


def point_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return as_points(jobs.read_stream(spark, f"{sf}/events*.parquet", schema))


_FENCES = P.combine("FENCE", [*P.city_buffers("Paris"), *P.city_buffers("Tokyo"), ("beijing", P.beijing())],
                    [("W1", P.during("2024-01-01", "2024-01-08")), ("W2", P.during("2024-01-08", "2024-01-15"))])


@query("str_geofence", with_ctes(
    "geo_events", f"SELECT f.fid, w.name FROM hits h JOIN geo_events f ON f.fid = h.fid JOIN windows w ON w.geom_id = h.geom_id AND {span_test('f.ts')}",
    windows_cte(_FENCES[1]), shapes_cte(_FENCES[0]), hits_cte("geo_events")))
def str_geofence(spark, sf):
    fenced = jobs.geofence(point_stream(spark, sf), window_set(spark, *_FENCES))
    return jobs.drain(fenced.select("fid", "name"), "geofence")


@query("str_latest", with_ctes(
    "geo_events", "SELECT user_id, ts, fid, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, fid DESC) AS r FROM geo_events) WHERE r = 1"))
def str_latest(spark, sf):
    return jobs.latest(point_stream(spark, sf), "user_id", "ts", ["ts", "fid", "lon", "lat"])


@query("str_cell_counts", with_ctes(
    "geo_events", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", CAST(floor((lon+180e0)/360e0*32e0) AS BIGINT) AS cx, "
    "CAST(floor((lat+90e0)/180e0*32e0) AS BIGINT) AS cy, count(*) AS n FROM geo_events "
    "WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL"))
def str_cell_counts(spark, sf):
    """Closed hours only: the last hours stay in the state until later data arrives."""
    return jobs.drain(jobs.cell_counts(point_stream(spark, sf), 5, "1 hour", "10 minutes"), "cells")


@query("str_cell_counts_drained", with_ctes(
    "geo_events", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", CAST(floor((lon+180e0)/360e0*32e0) AS BIGINT) AS cx, "
    "CAST(floor((lat+90e0)/180e0*32e0) AS BIGINT) AS cy, count(*) AS n FROM geo_events GROUP BY ALL"))
def str_cell_counts_drained(spark, sf):
    """All hours, those that are open when the source ends among them."""
    return jobs.all_cell_counts(point_stream(spark, sf), 5, "1 hour", "10 minutes")


@query("str_ingest", with_ctes("geo_events", "SELECT CAST(floor(epoch(ts)/86400) AS BIGINT) AS period, count(*) AS n, CAST(sum(fid) AS BIGINT) AS fids FROM geo_events GROUP BY 1"))
def str_ingest(spark, sf):
    base = scratch_dir(spark, "ingest")
    jobs.ingest(point_stream(spark, sf), base + "/out", base + "/checkpoint").awaitTermination()
    return spark.read.parquet(base + "/out").groupBy(F.col("period").cast("bigint").alias("period")).agg(
        F.count("*").alias("n"), F.sum("fid").alias("fids"))
