"""Analytics of run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import draws, labels
from waymark.operators import quantiles, results
from waymark.plans import presets as P, regions as R
from waymark.plans.fixtures import geo_orders, run_results, table, track_table, with_ctes
from waymark.plans.q_projections import _DAYS_SQL, _SIZE_SQL
from waymark.plans.registry import query
from waymark.sources.tables import is_loose_flag, is_test_flag

N = '"queryName"'


def labelled(spark, sf):
    name = F.col("queryName")
    return run_results(spark, sf).withColumn("days", labels.days(name)).withColumn("size", labels.size_km(name))


_LABELLED = f"labelled AS (SELECT *, {_DAYS_SQL} AS days, {_SIZE_SQL} AS size FROM runs)"


def _runs(body, *extra):
    return with_ctes("runs", body, *extra)


# ---- filters -------------------------------------------------------------------------------------

@query("flt_name_contains", _runs(f"SELECT uuid FROM runs WHERE regexp_matches({N}, 'SIX-DAYS|TWO-WEEKS') AND NOT regexp_matches({N}, 'LOOSE')"))
def flt_name_contains(spark, sf):
    name = F.col("queryName")
    return run_results(spark, sf).filter(name.rlike("SIX-DAYS|TWO-WEEKS") & ~name.rlike("LOOSE")).select("uuid")


@query("flt_cluster", _runs("SELECT uuid, \"clusterId\" FROM runs WHERE \"clusterId\" = 'cluster-0' OR \"clusterId\" IN ('cluster-2', 'cluster-3')"))
def flt_cluster(spark, sf):
    c = F.col("clusterId")
    return run_results(spark, sf).filter((c == "cluster-0") | c.isin("cluster-2", "cluster-3")).select("uuid", "clusterId")


@query("flt_result_range", _runs("SELECT uuid, result FROM runs WHERE (result > 0 AND result < 10000 AND result >= 1000 AND result < 1200) OR (result < 10000 AND result > 9000 AND result < 1000000)"))
def flt_result_range(spark, sf):
    r = F.col("result")
    return run_results(spark, sf).filter(
        ((r > 0) & (r < 10000) & (r >= 1000) & (r < 1200)) | ((r < 10000) & (r > 9000) & (r < 1000000))).select("uuid", "result")


@query("flt_label", _runs("SELECT uuid, days, size FROM labelled WHERE (days = 168 OR days = 56 OR days > 300 OR days < 10) AND size = 150", _LABELLED))
def flt_label(spark, sf):
    d = F.col("days")
    return labelled(spark, sf).filter(((d == 168) | (d == 56) | (d > 300) | (d < 10)) & (F.col("size") == 150)).select("uuid", "days", "size")


def _bin_sql(n, source="runs", by=""):
    probs = ", ".join(f"{i}/{n}e0" for i in range(n + 1))
    group = f"{by}, " if by else ""
    edges = f"edges AS (SELECT {group}quantile_cont(CAST(result AS DOUBLE), [{probs}]) AS e FROM {source}" + (f" GROUP BY {by})" if by else ")")
    join = f"JOIN edges ON edges.{by} = r.{by}" if by else ", edges"
    binned = f"binned AS (SELECT r.*, len(list_filter(e[2:{n}], lambda x: x < r.result)) AS range_group FROM {source} r {join})"
    return [edges, binned]


@query("win_qcut", _runs("SELECT uuid, result, range_group FROM binned", *_bin_sql(30)))
def win_qcut(spark, sf):
    return quantiles.with_bins(run_results(spark, sf), "result", 30).select("uuid", "result", F.col("range_group").cast("bigint").alias("range_group"))


@query("win_qcut_by_group", _runs("SELECT uuid, days, range_group FROM binned", _LABELLED, *_bin_sql(10, "labelled", "days")))
def win_qcut_by_group(spark, sf):
    return quantiles.with_bins(labelled(spark, sf), "result", 10, ["days"]).select("uuid", "days", F.col("range_group").cast("bigint").alias("range_group"))


@query("flt_range_cap", _runs("SELECT range_group, round(avg(duration), 6) AS duration FROM binned WHERE range_group < 20 GROUP BY range_group", *_bin_sql(30)))
def flt_range_cap(spark, sf):
    binned = quantiles.with_bins(run_results(spark, sf), "result", 30).filter(F.col("range_group") < 20)
    return results.mean_by(binned, ["range_group"], ["duration"]).select(
        F.col("range_group").cast("bigint").alias("range_group"), F.round("duration", 6).alias("duration"))


_SKEWED = "skewed AS (SELECT *, CASE WHEN k % 50 = 0 THEN duration * 3 ELSE duration END AS d FROM (SELECT *, CAST(substr(uuid, 5) AS BIGINT) AS k FROM runs))"


def _skewed(spark, sf):
    k = F.substring("uuid", 5, 20).cast("bigint")
    return run_results(spark, sf).withColumn("duration", F.when(k % 50 == 0, F.col("duration") * 3).otherwise(F.col("duration")))


@query("flt_outliers_iqr", _runs(
    "SELECT uuid, d AS duration FROM skewed, (SELECT quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM skewed) "
    "WHERE d BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)", _SKEWED))
def flt_outliers_iqr(spark, sf):
    return results.without_outliers(_skewed(spark, sf)).select("uuid", "duration")


def _flag_sql(column):
    return f"CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'x' END AS {column}"


def _flags(spark, sf):
    k = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, "true").when(k == 1, "false").when(k == 2, "x").alias("o"))


@query("flt_loose_flag", f"SELECT o_orderkey, coalesce(o = 'true', FALSE) AS v FROM (SELECT o_orderkey, {_flag_sql('o')} FROM orders)")
def flt_loose_flag(spark, sf):
    return _flags(spark, sf).select("o_orderkey", is_loose_flag(F.col("o")).alias("v"))


@query("flt_test_flag", f"SELECT o_orderkey, coalesce(o <> 'false', TRUE) AS v FROM (SELECT o_orderkey, {_flag_sql('o')} FROM orders)")
def flt_test_flag(spark, sf):
    return _flags(spark, sf).select("o_orderkey", is_test_flag(F.col("o")).alias("v"))


# ---- joins ---------------------------------------------------------------------------------------

_SIDES = ("ma AS (SELECT \"queryName\", min(result) AS a_result FROM runs WHERE system = 'A' GROUP BY 1), "
          "mb AS (SELECT \"queryName\", min(result) AS b_result FROM runs WHERE system = 'B' GROUP BY 1), "
          "matched AS (SELECT ma.\"queryName\", a_result, b_result FROM ma JOIN mb USING (\"queryName\"))")


@query("join_results_by_name", _runs("SELECT * FROM matched", _SIDES))
def join_results_by_name(spark, sf):
    return results.matched_results(run_results(spark, sf))


@query("join_results_chain", _runs(
    "SELECT * FROM " + " JOIN ".join(
        f"(SELECT \"queryName\", round(avg(duration), 6) AS {c}_duration, round(avg(\"timeAtFirstResult\" - \"startTime\"), 6) AS {c}_ttfr FROM runs WHERE \"clusterId\" = 'cluster-{i}' GROUP BY 1)"
        + (" USING (\"queryName\")" if i else "") for i, c in enumerate("abcd"))))
def join_results_chain(spark, sf):
    c = F.col("clusterId")
    merged = results.chain(run_results(spark, sf), {label: c == f"cluster-{i}" for i, label in enumerate("abcd")},
                           {"duration": F.col("duration"), "ttfr": labels.first_result_delay()})
    return merged.select("queryName", *[F.round(f"{s}_{v}", 6).alias(f"{s}_{v}") for s in "abcd" for v in ("duration", "ttfr")])


@query("join_mismatch", _runs("SELECT * FROM matched WHERE a_result <> b_result AND NOT contains(\"queryName\", 'LOOSE')", _SIDES))
def join_mismatch(spark, sf):
    return results.mismatches(results.matched_results(run_results(spark, sf)))


@query("join_match", _runs("SELECT * FROM matched WHERE a_result = b_result AND NOT contains(\"queryName\", 'LOOSE')", _SIDES))
def join_match(spark, sf):
    return results.mismatches(results.matched_results(run_results(spark, sf)), differ=False)


@query("join_concurrency", _runs(
    'SELECT i.uuid, i.system, (SELECT count(*) FROM runs j WHERE j.system = i.system AND j."startTime" <= i."startTime" AND j."endTime" > i."startTime") AS in_flight FROM runs i '))
def join_concurrency(spark, sf):
    return results.concurrency(run_results(spark, sf)).select("uuid", "system", "in_flight")


# ---- aggregations --------------------------------------------------------------------------------

@query("agg_mean_by", _runs("SELECT size, days, system, round(avg(duration), 6) AS duration, round(avg(result), 6) AS result FROM labelled GROUP BY size, days, system", _LABELLED))
def agg_mean_by(spark, sf):
    means = results.mean_by(labelled(spark, sf), ["size", "days", "system"], ["duration", "result"])
    return means.select("size", "days", "system", F.round("duration", 6).alias("duration"), F.round("result", 6).alias("result"))


_RANGE = '(SELECT "queryName", min(result) AS min, max(result) AS max, round(avg(result), 6) AS mean FROM runs GROUP BY 1)'


@query("agg_min_max_mean", _runs(f"SELECT *, min <> max AS varies FROM {_RANGE}"))
def agg_min_max_mean(spark, sf):
    return results.result_range(run_results(spark, sf)).select(
        "queryName", "min", "max", F.round("mean", 6).alias("mean"), (F.col("min") != F.col("max")).alias("varies"))


@query("agg_min_by", _runs('SELECT "queryName", system, min(result) AS result FROM runs GROUP BY 1, 2'))
def agg_min_by(spark, sf):
    return run_results(spark, sf).groupBy("queryName", "system").agg(F.min("result").alias("result"))


@query("agg_describe", _runs(
    "SELECT count(result) AS count, round(avg(result), 6) AS mean, round(stddev(result), 6) AS std, CAST(min(result) AS DOUBLE) AS min, "
    "quantile_cont(CAST(result AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(result AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(result AS DOUBLE), 0.75) AS p75, "
    "CAST(max(result) AS DOUBLE) AS max FROM runs"))
def agg_describe(spark, sf):
    runs = run_results(spark, sf)
    out = results.describe(runs, "result", quantiles.exact_quantiles(runs, "result", [0.25, 0.5, 0.75]))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("agg_boxplot", _runs(
    "SELECT s.system, s.days, q1, median, q3, min(duration) AS low, max(duration) AS high FROM labelled s JOIN (SELECT system, days, "
    "quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.5) AS median, quantile_cont(duration, 0.75) AS q3 FROM labelled GROUP BY 1, 2) q "
    "ON q.system = s.system AND q.days = s.days WHERE duration BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) GROUP BY ALL", _LABELLED))
def agg_boxplot(spark, sf):
    return results.boxplot(labelled(spark, sf), ["system", "days"])


@query("agg_histogram", _runs(
    "SELECT CAST(least(floor((duration-lo)/(hi-lo)*20), 19) AS INTEGER) AS bin, count(*) AS n FROM runs, (SELECT CAST(min(duration) AS DOUBLE) AS lo, CAST(max(duration) AS DOUBLE) AS hi FROM runs) GROUP BY 1"))
def agg_histogram(spark, sf):
    return results.histogram(run_results(spark, sf), "duration", 20)


@query("agg_distinct", _runs('SELECT system, count(DISTINCT "queryName") AS names, count(DISTINCT "clusterId") AS clusters FROM runs GROUP BY system'))
def agg_distinct(spark, sf):
    return run_results(spark, sf).groupBy("system").agg(
        F.countDistinct("queryName").alias("names"), F.countDistinct("clusterId").alias("clusters"))


_NULLABLE = "nullif(duration % 10, 0) AS d, nullif(result % 7, 3) AS r"


@query("agg_count_columns", _runs(f"SELECT count(uuid) AS uuid, count(d) AS d, count(r) AS r FROM (SELECT uuid, {_NULLABLE} FROM runs)"))
def agg_count_columns(spark, sf):
    holes = run_results(spark, sf).selectExpr("uuid", *_NULLABLE.split(", n")[0:1], "n" + _NULLABLE.split(", n")[1])
    return holes.agg(*[F.count(c).alias(c) for c in holes.columns])


@query("agg_regression", _runs(
    "SELECT uuid, r.system, round(intercept + slope*result, 4) AS predicted FROM runs r JOIN (SELECT system, regr_slope(duration, result) AS slope, "
    "regr_intercept(duration, result) AS intercept FROM runs GROUP BY system) s ON s.system = r.system"))
def agg_regression(spark, sf):
    runs = run_results(spark, sf)
    return results.predict(runs, results.regression(runs, ["system"]), ["system"]).select("uuid", "system", F.round("predicted", 4).alias("predicted"))


_PAIRS = ("pairs AS (SELECT a.\"queryName\", a.duration AS a_duration, b.duration AS b_duration, a.result AS a_result, b.result AS b_result FROM runs a JOIN runs b "
          "ON CAST(substr(a.uuid, 5) AS BIGINT) + 1 = CAST(substr(b.uuid, 5) AS BIGINT) WHERE a.system = 'A' AND b.system = 'B'), "
          "won AS (SELECT \"queryName\", CASE WHEN b_duration < a_duration THEN 'B' ELSE 'A' END AS winner, a_result <> b_result AND NOT contains(\"queryName\", 'LOOSE') AS mismatch FROM pairs)")


def _pairs(spark, sf):
    """Both systems' runs of one request: neighbouring run numbers."""
    runs = run_results(spark, sf).withColumn("request", F.floor(F.substring("uuid", 5, 20).cast("bigint") / 2))
    side = lambda s: runs.filter(F.col("system") == s).select(
        "request", *([] if s == "B" else ["queryName"]), F.col("duration").alias(f"{s.lower()}_duration"), F.col("result").alias(f"{s.lower()}_result"))
    return side("A").join(side("B"), "request")


@query("agg_wins", _runs("SELECT winner, count(*) AS won, count(*) FILTER (WHERE mismatch) AS mismatches FROM won GROUP BY winner", _PAIRS))
def agg_wins(spark, sf):
    return results.winners(_pairs(spark, sf)).groupBy("winner").agg(F.count("*").alias("won"), F.count_if("mismatch").alias("mismatches"))


@query("agg_wins_names", _runs('SELECT "queryName", winner, mismatch FROM won', _PAIRS))
def agg_wins_names(spark, sf):
    return results.winners(_pairs(spark, sf))


@query("agg_slow_requests", _runs('SELECT system, "queryName", count(*) AS n FROM runs WHERE duration > 10000 GROUP BY 1, 2'))
def agg_slow_requests(spark, sf):
    return results.slow_requests(run_results(spark, sf))


@query("agg_group_values", _runs(
    'SELECT "queryName", system, duration, "timeAtFirstResult" - "startTime" AS first, "endTime" - "timeAtFirstResult" AS rest, '
    'count(*) OVER w AS n, min(result) OVER w <> max(result) OVER w AS differs FROM runs WINDOW w AS (PARTITION BY "queryName", system)'))
def agg_group_values(spark, sf):
    return results.group_values(run_results(spark, sf))


@query("agg_latency_summary", _runs(
    "SELECT system, count(*) AS n, min(duration) AS min, max(duration) AS max, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std, "
    "round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.75), 6) AS p75, round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99, "
    "round(count(*)/((max(\"endTime\")-min(\"startTime\"))/1000e0), 9) AS per_second FROM runs GROUP BY system"))
def agg_latency_summary(spark, sf):
    out = results.latency_summary(run_results(spark, sf), ["system"])
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "p50", "p75", "p95", "p99")}
    return out.withColumns({**rounded, "per_second": F.round("per_second", 9)})


@query("agg_latency_bands", _runs(
    "SELECT system, round(count(*) FILTER (WHERE NOT test AND duration < 800)/CAST(count(*) AS DOUBLE), 6) AS fast, round(count(*) FILTER (WHERE NOT test AND duration BETWEEN 800 AND 1200)/CAST(count(*) AS DOUBLE), 6) AS middle, "
    "round(count(*) FILTER (WHERE NOT test AND duration > 1200)/CAST(count(*) AS DOUBLE), 6) AS slow, round(count(*) FILTER (WHERE test)/CAST(count(*) AS DOUBLE), 6) AS failed FROM runs GROUP BY system"))
def agg_latency_bands(spark, sf):
    bands = results.latency_bands(run_results(spark, sf), ["system"], ~F.col("test"))
    return bands.select("system", *[F.round(c, 6).alias(c) for c in ("fast", "middle", "slow", "failed")])


@query("agg_requests_by_key", _runs(
    "SELECT size, days, count(*) FILTER (WHERE duration <= 10000) AS ok, count(*) FILTER (WHERE duration > 10000) AS ko FROM labelled GROUP BY ROLLUP (size, days)", _LABELLED))
def agg_requests_by_key(spark, sf):
    return results.requests_by_key(labelled(spark, sf), ["size", "days"], F.col("duration") <= 10000)


@query("agg_track_stats", with_ctes(
    "tracks", "SELECT count(*) AS n, round(min(metres), 3) AS min, round(max(metres), 3) AS max, round(avg(metres), 3) AS mean, round(stddev_samp(metres), 3) AS std, "
    "round(quantile_cont(metres, 0.5), 3) AS median, round(avg(pow((metres-m)/s, 3)), 5) AS skewness, round(avg(pow((metres-m)/s, 4)) - 3, 5) AS kurtosis "
    "FROM tracks, (SELECT avg(metres) AS m, stddev_pop(metres) AS s FROM tracks)"))
def agg_track_stats(spark, sf):
    """Population skewness and excess kurtosis, exact median."""
    tracks = track_table(spark, sf)
    median = quantiles.exact_quantiles(tracks, "metres", [0.5]).select(F.get("q", F.lit(0))).scalar()
    return tracks.agg(
        F.count("*").alias("n"), F.round(F.min("metres"), 3).alias("min"), F.round(F.max("metres"), 3).alias("max"),
        F.round(F.avg("metres"), 3).alias("mean"), F.round(F.stddev("metres"), 3).alias("std"),
        F.round(F.skewness("metres"), 5).alias("skewness"), F.round(F.kurtosis("metres"), 5).alias("kurtosis"),
    ).withColumn("median", F.round(median, 3))


# ---- windows, orders, sets -----------------------------------------------------------------------

@query("win_first_result", "SELECT user_id, min(ts) AS first_result, count(*) AS n FROM events GROUP BY user_id")
def win_first_result(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_result"), F.count("*").alias("n"))


@query("win_drop_warmup", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r > 1")
def win_drop_warmup(spark, sf):
    return results.without_warmup(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("srt_shuffle", _runs("SELECT uuid, md5('9|shuffle|' || uuid) AS at FROM runs"))
def srt_shuffle(spark, sf):
    """Random order that a second run repeats: sorted by a hash of seed and id."""
    return run_results(spark, sf).select("uuid", draws._digest(9, "shuffle", F.col("uuid")).alias("at")).orderBy("at", "uuid")


@query("lim_head", _runs('SELECT uuid, "startTime" FROM runs ORDER BY "startTime", uuid LIMIT 3'))
def lim_head(spark, sf):
    return run_results(spark, sf).select("uuid", "startTime").orderBy("startTime", "uuid").limit(3)


_LEVELS = list(range(1, 9))
_WEIGHTS = [2**(2 * z - 1) for z in _LEVELS]
_CUMULATED = [sum(_WEIGHTS[:i + 1]) for i in range(len(_WEIGHTS))]


# How often the windows of a month, 27, 18 and 9 days, a week and 5 days follow each other in the year.
_WINDOW_STEPS = [12, 13, 20, 40, 52, 73]


def _draw_cell_sql():
    u = lambda s: draws.unit_sql(11, s, "o_orderkey")
    level = "CASE " + " ".join(f"WHEN {u('level')}*{float(_CUMULATED[-1])!r}e0 < {float(c)!r}e0 THEN {z}" for z, c in zip(_LEVELS, _CUMULATED)) + " END"
    return (f"SELECT o_orderkey, level, CAST(floor({u('col')}*pow(2e0, level)) AS BIGINT) AS col, CAST(floor({u('row')}*pow(2e0, level-1)) AS BIGINT) AS row, "
            f"CAST(floor({u('window')}*6e0) AS BIGINT) AS \"window\", CAST(floor({u('index')}*[{', '.join(f'{n}e0' for n in _WINDOW_STEPS)}][CAST(floor({u('window')}*6e0) AS INTEGER) + 1]) AS BIGINT) AS index "
            f"FROM (SELECT o_orderkey, {level} AS level FROM orders)")


@query("smp_weighted", _draw_cell_sql())
def smp_weighted(spark, sf):
    """A request per row: level by its number of cells, then cell, window and the window's index in the year."""
    k = F.col("o_orderkey")
    u = lambda s: draws.unit(11, s, k)
    at, level = u("level") * float(_CUMULATED[-1]), None
    for z, c in zip(_LEVELS, _CUMULATED):
        level = F.when(at < float(c), z) if level is None else level.when(at < float(c), z)
    drawn = table(spark, sf, "orders").select(k, level.alias("level"))
    return drawn.select(k, "level", F.floor(u("col") * F.pow(F.lit(2.0), F.col("level"))).alias("col"),
                        F.floor(u("row") * F.pow(F.lit(2.0), F.col("level") - 1)).alias("row"), F.floor(u("window") * 6.0).alias("window"),
                        F.floor(u("index") * F.get(F.array(*[F.lit(float(n)) for n in _WINDOW_STEPS]), F.floor(u("window") * 6.0).cast("int"))).alias("index"))


_KINDS = ["six-MONTHS", "TWO-MONTHS", "TWO-WEEKS", "SIX-DAYS"]


def _texts(values):
    return F.array(*[F.lit(str(v)) for v in values])


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("set_request_space", with_ctes(
    "geo_orders", f"SELECT year || '/' || city || '/' || size || '/' || kind AS request FROM (SELECT *, unnest({_sql_list(_KINDS)}) AS kind FROM (SELECT *, unnest({_sql_list(R.CITY_BUFFER_KM)}) AS size FROM "
    f"(SELECT DISTINCT extract(year FROM day) AS year, city FROM geo_orders))) UNION ALL SELECT year || '/' || country FROM (SELECT year, unnest({_sql_list(R.SOUTH_AMERICA)}) AS country FROM "
    "(SELECT DISTINCT extract(year FROM day) AS year FROM geo_orders))"))
def set_request_space(spark, sf):
    """Requests for all years and cities present, in random order."""
    places = geo_orders(spark, sf).select(F.year("day").cast("string").alias("year"), "city").distinct()
    buffers = places.withColumn("size", F.explode(_texts(R.CITY_BUFFER_KM))).withColumn("kind", F.explode(_texts(_KINDS)))
    lands = places.select("year").distinct().withColumn("country", F.explode(_texts(R.SOUTH_AMERICA)))
    requests = buffers.select(F.concat_ws("/", "year", "city", "size", "kind").alias("request")).unionByName(
        lands.select(F.concat_ws("/", "year", "country").alias("request")))
    return requests.orderBy(draws._digest(3, "order", F.col("request")))


@query("set_concat", _runs("SELECT uuid, 'system ' || system || CASE WHEN contains(\"queryName\", 'LOOSE') THEN ' (loose)' ELSE '' END AS system_desc FROM runs"))
def set_concat(spark, sf):
    runs, loose = run_results(spark, sf), F.col("queryName").contains("LOOSE")
    parts = [
        runs.filter((F.col("system") == s) & test).select("uuid", F.lit(f"system {s}{suffix}").alias("system_desc"))
        for s in "AB" for test, suffix in ((~loose, ""), (loose, " (loose)"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("set_periods", "SELECT year || '-' || m.label AS name, make_timestamp(year, m.a, 1, 0, 0, 0) AS t_from, make_timestamp(year + m.later, m.b, 1, 0, 0, 0) AS t_to "
                      "FROM (SELECT DISTINCT extract(year FROM o_orderdate) AS year FROM orders), (VALUES "
                      + ", ".join(["('firsthalf', 1, 6, 0)", "('lasthalf', 6, 1, 1)"] + [f"('M{m:02d}', {m}, {m % 12 + 1}, {m // 12})" for m in range(1, 13)]) + ") m(label, a, b, later)")
def set_periods(spark, sf):
    """Halves and months of every year present."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    spec = [("firsthalf", 1, 6, 0), ("lasthalf", 6, 1, 1)] + [(f"M{m:02d}", m, m % 12 + 1, m // 12) for m in range(1, 13)]
    periods = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("a"), F.lit(c).alias("b"), F.lit(d).alias("later")) for a, b, c, d in spec])
    first = lambda y, m: F.make_date(y, m, F.lit(1)).cast("timestamp_ntz")
    return years.select("year", F.inline(periods)).select(
        F.concat_ws("-", F.col("year").cast("string"), "label").alias("name"), first(F.col("year"), F.col("a")).alias("t_from"),
        first(F.col("year") + F.col("later"), F.col("b")).alias("t_to"))


@query("set_dedup", _runs("SELECT DISTINCT size, days FROM labelled", _LABELLED))
def set_dedup(spark, sf):
    return labelled(spark, sf).select("size", "days").dropDuplicates(["size", "days"])


@query("join_region_time", "SELECT n_name || '-' || y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS name FROM nation, (SELECT DISTINCT extract(year FROM o_orderdate) AS y FROM orders), range(1, 13) r(m)")
def join_region_time(spark, sf):
    """Every region in every month of the years from the first to the last order."""
    years = table(spark, sf, "orders").agg(F.sequence(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate")))).scalar()
    months = table(spark, sf, "nation").select("n_name", F.explode(years).alias("y")).withColumn(
        "m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return months.select(F.concat_ws("-", "n_name", F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("name"))
