"""Result analytics over runs with holes: missing systems, names, and starts are groups and rows like others."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import results
from waymark.plans.fixtures import run_results, table, with_ctes
from waymark.plans.registry import query


def holed_runs(spark, sf):
    """Run results in which every fifth system, eleventh name and thirteenth start is missing."""
    k = F.substring("uuid", 5, 20).cast("bigint")
    holes = {"system": 5, "queryName": 11, "startTime": 13}
    return run_results(spark, sf).withColumn("k", k).withColumns({c: F.when(F.col("k") % n != 0, F.col(c)) for c, n in holes.items()})


def _holed(body, *extra):
    return with_ctes(
        "runs", body, "numbered AS (SELECT *, CAST(substr(uuid, 5) AS BIGINT) AS k FROM runs), "
        "holed AS (SELECT * REPLACE (CASE WHEN k % 5 <> 0 THEN system END AS system, CASE WHEN k % 11 <> 0 THEN \"queryName\" END AS \"queryName\", "
        "CASE WHEN k % 13 <> 0 THEN \"startTime\" END AS \"startTime\") FROM numbered)", *extra)


@query("join_concurrency_nulls", _holed(
    'SELECT i.uuid, i.system, CASE WHEN i."startTime" IS NOT NULL THEN (SELECT count(*) FROM holed j WHERE j.system IS NOT DISTINCT FROM i.system '
    'AND j."startTime" <= i."startTime" AND j."endTime" > i."startTime") END AS in_flight FROM holed i'))
def join_concurrency_nulls(spark, sf):
    return results.concurrency(holed_runs(spark, sf)).select("uuid", "system", "in_flight")


@query("join_results_by_name_nulls", _holed(
    "SELECT a.\"queryName\", a_result, b_result FROM (SELECT \"queryName\", min(result) AS a_result FROM holed WHERE system = 'A' GROUP BY 1) a JOIN "
    "(SELECT \"queryName\", min(result) AS b_result FROM holed WHERE system = 'B' GROUP BY 1) b ON a.\"queryName\" IS NOT DISTINCT FROM b.\"queryName\""))
def join_results_by_name_nulls(spark, sf):
    return results.matched_results(holed_runs(spark, sf))


@query("agg_boxplot_nulls", _holed(
    "SELECT s.system, q1, median, q3, min(duration) AS low, max(duration) AS high FROM holed s JOIN (SELECT system, "
    "quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.5) AS median, quantile_cont(duration, 0.75) AS q3 FROM holed GROUP BY 1) q "
    "ON q.system IS NOT DISTINCT FROM s.system WHERE duration BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) GROUP BY ALL"))
def agg_boxplot_nulls(spark, sf):
    return results.boxplot(holed_runs(spark, sf), ["system"])


@query("agg_regression_nulls", _holed(
    "SELECT uuid, r.system, round(intercept + slope*result, 4) AS predicted FROM holed r JOIN (SELECT system, regr_slope(duration, result) AS slope, "
    "regr_intercept(duration, result) AS intercept FROM holed GROUP BY system) s ON s.system IS NOT DISTINCT FROM r.system"))
def agg_regression_nulls(spark, sf):
    runs = holed_runs(spark, sf)
    return results.predict(runs, results.regression(runs, ["system"]), ["system"]).select("uuid", "system", F.round("predicted", 4).alias("predicted"))


@query("agg_group_values_nulls", _holed(
    'SELECT "queryName", system, duration, "timeAtFirstResult" - "startTime" AS first, "endTime" - "timeAtFirstResult" AS rest, '
    'count(*) OVER w AS n, min(result) OVER w <> max(result) OVER w AS differs FROM holed WINDOW w AS (PARTITION BY "queryName", system)'))
def agg_group_values_nulls(spark, sf):
    return results.group_values(holed_runs(spark, sf))


@query("agg_latency_summary_nulls", _holed(
    "SELECT system, \"queryName\", count(*) AS n, min(duration) AS min, max(duration) AS max, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std, "
    "round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.75), 6) AS p75, round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99, "
    "round(count(*)/nullif((max(\"endTime\")-min(\"startTime\"))/1000e0, 0e0), 9) AS per_second FROM holed GROUP BY system, \"queryName\""))
def agg_latency_summary_nulls(spark, sf):
    out = results.latency_summary(holed_runs(spark, sf), ["system", "queryName"])
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "p50", "p75", "p95", "p99")}
    return out.withColumns({**rounded, "per_second": F.round("per_second", 9)})


@query("win_drop_warmup_nulls", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM "
       "(SELECT CASE WHEN user_id % 7 <> 0 THEN user_id END AS user_id, event_id FROM events)) WHERE r > 1")
def win_drop_warmup_nulls(spark, sf):
    events = table(spark, sf, "events").select(F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), "event_id")
    return results.without_warmup(events, "user_id", "event_id")
