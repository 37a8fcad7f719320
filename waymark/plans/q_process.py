"""Processes described for the compared systems; definitions beyond that description are this library's."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.times import ntz
from waymark.operators import clusters, nearest, process
from waymark.operators.skew import lead_in_key
from waymark.plans import regions as R
from waymark.plans.fixtures import geo_events, geo_orders, mx_sql, my_sql, stored_segments, table, with_ctes
from waymark.plans.registry import query
from waymark.plans.sqltext import num
from waymark.session import cut_lineage, scratch_dir

_BOX = (-10.0, 40.0, 60.0, 65.0)
_IN_BOX_SQL = f"lon BETWEEN {num(_BOX[0])} AND {num(_BOX[2])} AND lat BETWEEN {num(_BOX[1])} AND {num(_BOX[3])}"


def _boxed(spark, sf):
    return geo_events(spark, sf).filter(geo.in_box(F.col("lon"), F.col("lat"), _BOX))


@query("b_heatmap", with_ctes(
    "geo_events", f"SELECT CAST(floor((lon+180e0)/360e0*128e0) AS BIGINT) AS cx, CAST(floor((lat+90e0)/180e0*128e0) AS BIGINT) AS cy, count(*) AS n, round(sum(value), 4) AS weight "
    f"FROM geo_events WHERE {_IN_BOX_SQL} GROUP BY ALL"))
def b_heatmap(spark, sf):
    return process.heatmap(_boxed(spark, sf), 7, F.col("value")).withColumn("weight", F.round("weight", 4))


@query("b_stats", with_ctes("geo_events", f"SELECT count(value) AS n, min(value) AS min, max(value) AS max FROM geo_events WHERE {_IN_BOX_SQL}"))
def b_stats(spark, sf):
    return process.bounds(_boxed(spark, sf), "value")


@query("b_stats_enumeration", with_ctes("geo_events", f"SELECT event_type, count(*) AS n FROM geo_events WHERE {_IN_BOX_SQL} GROUP BY 1"))
def b_stats_enumeration(spark, sf):
    return process.enumeration(_boxed(spark, sf), "event_type")


@query("b_stats_histogram", with_ctes(
    "geo_events", "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE CAST(floor(value/100e0*20) AS BIGINT) + 1 END AS bin, count(*) AS n "
    f"FROM geo_events WHERE {_IN_BOX_SQL} GROUP BY 1"))
def b_stats_histogram(spark, sf):
    return process.value_histogram(_boxed(spark, sf), "value", 0.0, 100.0, 20)


@query("b_stats_topk", with_ctes("geo_events", f"SELECT user_id, count(*) AS n FROM geo_events WHERE {_IN_BOX_SQL} GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10"))
def b_stats_topk(spark, sf):
    return process.top_k(_boxed(spark, sf), "user_id", 10)


@query("b_stats_frequency", with_ctes(
    "geo_events", "SELECT user_id, min(coalesce(n, 0)) AS estimate FROM asked LEFT JOIN counts USING (line, bucket) GROUP BY user_id HAVING min(coalesce(n, 0)) > 0",
    "asked AS (SELECT DISTINCT user_id, line, CAST('0x' || substr(md5(line || '|' || user_id), 1, 8) AS BIGINT) % 64 AS bucket FROM geo_events, range(4) l(line))",
    f"counts AS (SELECT line, bucket, count(*) AS n FROM geo_events JOIN asked USING (user_id) WHERE {_IN_BOX_SQL} GROUP BY ALL)"))
def b_stats_frequency(spark, sf):
    """Count-min estimates for all users; few buckets, so that they collide."""
    users = geo_events(spark, sf).select("user_id").distinct()
    return process.frequency_estimates(users, process.frequency_table(_boxed(spark, sf), "user_id", 4, 64), "user_id", 4, 64).filter("estimate > 0")


@query("b_tube", with_ctes(
    "segs", "SELECT DISTINCT f.fid, s.track FROM geo_events f JOIN m s ON f.ts BETWEEN s.t1 AND s.t2 AND abs(f.lon - s.x1) < 20 WHERE "
    f"pow({mx_sql('f.lon')}-(s.ax+(s.ox-s.ax)*((epoch_ms(f.ts)/1000e0-s.s1)/(s.s2-s.s1))),2)+pow({my_sql('f.lat')}-(s.ay+(s.oy-s.ay)*((epoch_ms(f.ts)/1000e0-s.s1)/(s.s2-s.s1))),2) <= 30000e0*30000e0",
    f"m0 AS (SELECT track, x1, t1, t2, epoch_ms(t1)/1000e0 AS s1, epoch_ms(t2)/1000e0 AS s2, {mx_sql('x1')} AS ax, {my_sql('y1')} AS ay, {mx_sql('x2')} AS ox, {my_sql('y2')} AS oy FROM segs)",
    "m AS (SELECT * FROM m0 WHERE s2 > s1 AND sqrt(pow(ox-ax,2)+pow(oy-ay,2)) <= 50e0*(s2-s1))"))
def b_tube(spark, sf):
    """Events within 30 km of where any day track is at their time, for tracks of up to 50 m/s."""
    return process.tube_select(geo_events(spark, sf), stored_segments(spark, sf), 30_000.0, 50.0)


@query("b_proximity", with_ctes(
    "geo_events geo_orders", f"SELECT DISTINCT e.fid FROM (SELECT fid, {mx_sql('lon')} AS x, {my_sql('lat')} AS y FROM geo_events) e JOIN (SELECT {mx_sql('lon')} AS x, {my_sql('lat')} AS y FROM geo_orders) o "
    "ON o.x BETWEEN e.x - 5000e0 AND e.x + 5000e0 AND o.y BETWEEN e.y - 5000e0 AND e.y + 5000e0 AND pow(e.x-o.x,2)+pow(e.y-o.y,2) <= 25000000e0"))
def b_proximity(spark, sf):
    """Events within 5 km of any order's point."""
    return process.within_distance_of_any(geo_events(spark, sf), geo_orders(spark, sf), 5000.0).select("fid")


@query("b_knn", with_ctes(
    "geo_events", f"SELECT fid, round(sqrt(pow({mx_sql('lon')}-{mx_sql('2.35e0')},2)+pow({my_sql('lat')}-{my_sql('48.86e0')},2)), 3) AS metres FROM geo_events ORDER BY 2, fid LIMIT 25"))
def b_knn(spark, sf):
    return process.nearest_to_point(geo_events(spark, sf), 2.35, 48.86, 25).select("fid", F.round("metres", 3).alias("metres"))


@query("b_nn_join", with_ctes(
    "geo_events", "SELECT fid, nn, round(d2, 12) AS d2 FROM (SELECT a.fid, b.fid AS nn, pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2) AS d2, "
    "row_number() OVER (PARTITION BY a.fid ORDER BY (a.lon-b.lon)*(a.lon-b.lon)+(a.lat-b.lat)*(a.lat-b.lat), b.fid) AS r "
    "FROM geo_events a JOIN geo_events b ON a.fid <> b.fid AND b.lon BETWEEN a.lon - 3 AND a.lon + 3 AND b.lat BETWEEN a.lat - 3 AND a.lat + 3) WHERE r = 1"))
def b_nn_join(spark, sf):
    """Nearest other event of every event. The SQL looks within 3 degrees, where all have one."""
    return process.nearest_neighbours(geo_events(spark, sf)).select("fid", "nn", F.round("d2", 12).alias("d2"))


@query("b_knn_set", with_ctes(
    "geo_events", "SELECT fid, CAST(r AS INTEGER) AS rank, nn, round(d2, 12) AS d2 FROM (SELECT a.fid, b.fid AS nn, pow(a.lon-b.lon,2)+pow(a.lat-b.lat,2) AS d2, "
    "row_number() OVER (PARTITION BY a.fid ORDER BY (a.lon-b.lon)*(a.lon-b.lon)+(a.lat-b.lat)*(a.lat-b.lat), b.fid) AS r "
    "FROM geo_events a JOIN geo_events b ON a.fid <> b.fid AND b.lon BETWEEN a.lon - 4 AND a.lon + 4 AND b.lat BETWEEN a.lat - 4 AND a.lat + 4) WHERE r <= 5"))
def b_knn_set(spark, sf):
    """The five nearest other events of every event. The SQL looks within 4 degrees, where all have them."""
    return nearest.k_nearest(geo_events(spark, sf), 5).select("fid", "rank", "nn", F.round("d2", 12).alias("d2"))


@query("b_unique", with_ctes("geo_events", f"SELECT user_id, count(*) AS n FROM geo_events WHERE {_IN_BOX_SQL} GROUP BY 1"))
def b_unique(spark, sf):
    return process.enumeration(_boxed(spark, sf), "user_id")


@query("b_points_to_lines", with_ctes(
    "geo_events", "SELECT user_id, fid, fid2, x1, y1, x2, y2, same_day FROM (SELECT user_id, fid, lead(fid) OVER w AS fid2, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, "
    "CAST(ts AS DATE) = CAST(lead(ts) OVER w AS DATE) AS same_day FROM geo_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, fid)) WHERE fid2 IS NOT NULL"))
def b_points_to_lines(spark, sf):
    """Segments of each user's points; ``same_day`` tells which remain when lines break at midnight."""
    points = geo_events(spark, sf).select("fid", "ts", "user_id", "lon", "lat")
    led = lead_in_key(points, ["user_id"], ["ts", "fid"], ["fid", "ts", "lon", "lat"], "nxt").filter(F.col("nxt").isNotNull())
    return led.select("user_id", "fid", F.col("nxt.fid").alias("fid2"), F.col("lon").alias("x1"), F.col("lat").alias("y1"),
                      F.col("nxt.lon").alias("x2"), F.col("nxt.lat").alias("y2"), (F.to_date("ts") == F.to_date("nxt.ts")).alias("same_day"))


def _kmeans_sql(prefix: str, source: str, k: int, rounds: int) -> list[str]:
    """The rounds written out, over rows ``g, fid, lon, lat`` of ``source``; the last table is ``{prefix}{rounds}``."""
    steps = [f"{prefix}c0 AS (SELECT g, r - 1 AS c, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('kmeans|' || fid), fid) AS r FROM {source}) WHERE r <= {k})"]
    for i in range(rounds + 1):
        gap = "(p.lon - c.lon) * (p.lon - c.lon) + (p.lat - c.lat) * (p.lat - c.lat)"
        steps.append(f"{prefix}{i} AS (SELECT p.g, p.fid, any_value(p.lon) AS lon, any_value(p.lat) AS lat, arg_min(c.c, ({gap}, c.c)) AS c, min({gap}) AS d "
                     f"FROM {source} p JOIN {prefix}c{i} c ON c.g = p.g GROUP BY p.g, p.fid)")
        if i < rounds:
            steps.append(f"{prefix}c{i + 1} AS (SELECT o.g, o.c, coalesce(avg(p.lon), any_value(o.lon)) AS lon, coalesce(avg(p.lat), any_value(o.lat)) AS lat "
                         f"FROM {prefix}c{i} o LEFT JOIN {prefix}{i} p ON p.g = o.g AND p.c = o.c GROUP BY o.g, o.c)")
    return steps


_ALL_POINTS = "points AS (SELECT 0 AS g, fid, lon, lat FROM geo_events)"


@query("b_kmeans", with_ctes(
    "geo_events", "SELECT CAST(c AS INTEGER) AS cluster, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM k4 GROUP BY c", _ALL_POINTS, *_kmeans_sql("k", "points", 8, 4)))
def b_kmeans(spark, sf):
    clustered, _ = clusters.group_kmeans(geo_events(spark, sf).select("fid", "lon", "lat"), ["lon", "lat"], 8, rounds=4)
    return clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query("b_kmeans_groups", with_ctes(
    "geo_events", "SELECT g AS city, CAST(c AS INTEGER) AS cluster, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM k4 GROUP BY g, c",
    "points AS (SELECT city AS g, fid, lon, lat FROM geo_events)", *_kmeans_sql("k", "points", 3, 4)))
def b_kmeans_groups(spark, sf):
    """Three clusters in every city."""
    clustered, _ = clusters.group_kmeans(geo_events(spark, sf).select("city", "fid", "lon", "lat"), ["lon", "lat"], 3, ["city"], rounds=4)
    return clustered.groupBy("city", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query("b_kmeans_vectors")
def b_kmeans_vectors(spark, sf):
    """Spark ML's k-means of the embedding table, size and mean label per cluster."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(64)])
    clustered, _ = clusters.fit_kmeans(vectors, [f"v{i}" for i in range(64)], 8)
    return clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("label").alias("label"))


_JUMPS = " UNION ALL ".join(f"SELECT {k} AS k, avg(d) / 2 AS distortion FROM j{k}_2" for k in range(1, 5))


@query("b_jump", with_ctes(
    "geo_events", "SELECT CAST(k AS INTEGER) AS k, round(distortion, 6) AS distortion, round(jump, 9) AS jump, jump = max(jump) OVER () AS chosen FROM "
    "(SELECT k, distortion, 1 / distortion - coalesce(lag(1 / distortion) OVER (ORDER BY k), 0) AS jump FROM distortions)",
    _ALL_POINTS, *[step for k in range(1, 5) for step in _kmeans_sql(f"j{k}_", "points", k, 2)], f"distortions AS ({_JUMPS})"))
def b_jump(spark, sf):
    best, rows = clusters.jump_method(geo_events(spark, sf).select("fid", "lon", "lat"), ["lon", "lat"], 4, rounds=2)
    found = spark.createDataFrame([(k, d, j, k == best) for k, d, j in rows], "k int, distortion double, jump double, chosen boolean")
    return found.withColumn("distortion", F.round("distortion", 6)).withColumn("jump", F.round("jump", 9))


@query("b_kmeans_settled")
def b_kmeans_settled(spark, sf):
    """Twelve clusters, in rounds until the centres stay; no SQL, which would have to write out every round."""
    clustered, _ = clusters.settled_kmeans(cut_lineage(geo_events(spark, sf).select("fid", "lon", "lat")), ["lon", "lat"], 12)
    return clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query("b_jump_settled")
def b_jump_settled(spark, sf):
    """The jump among up to six clusters that have settled; no SQL, as for ``b_kmeans_settled``."""
    best, rows = clusters.jump_method(cut_lineage(geo_events(spark, sf).select("fid", "lon", "lat")), ["lon", "lat"], 6, rounds=None)
    found = spark.createDataFrame([(k, d, j, k == best) for k, d, j in rows], "k int, distortion double, jump double, chosen boolean")
    return found.withColumn("distortion", F.round("distortion", 6)).withColumn("jump", F.round("jump", 9))


@query("b_sample", with_ctes("geo_events", "SELECT fid, lon, lat FROM geo_events ORDER BY md5('4|sample|' || fid), fid LIMIT 100"))
def b_sample(spark, sf):
    return process.sample_overall(geo_events(spark, sf), 100, 4).select("fid", "lon", "lat")


@query("b_sample_groups", with_ctes(
    "geo_events", "SELECT city, fid FROM (SELECT city, fid, row_number() OVER (PARTITION BY city ORDER BY md5('4|sample|' || fid), fid) AS r FROM geo_events) WHERE r <= 10"))
def b_sample_groups(spark, sf):
    return process.sample_per_group(geo_events(spark, sf), "city", 10, 4).select("city", "fid")


@query("b_kde", with_ctes(
    "geo_events", "SELECT cx + dx AS cx, cy + dy AS cy, round(sum(n*exp(-(dx*dx+dy*dy)/4.5e0)), 6) AS density FROM "
    "(SELECT CAST(floor((lon+180e0)/360e0*128e0) AS BIGINT) AS cx, CAST(floor((lat+90e0)/180e0*128e0) AS BIGINT) AS cy, count(*) AS n FROM geo_events GROUP BY ALL), range(-4, 5) a(dx), range(-4, 5) b(dy) "
    "WHERE cx + dx BETWEEN 0 AND 127 AND cy + dy BETWEEN 0 AND 127 GROUP BY 1, 2"))
def b_kde(spark, sf):
    return process.kernel_density(geo_events(spark, sf), 7, 1.5, 4).withColumn("density", F.round("density", 6))


@query("b_assign", with_ctes(
    "geo_orders", "SELECT fid, arg_min(s.city, (pow(lon-slon,2)+pow(lat-slat,2), s.city)) AS centre FROM geo_orders o, sites s GROUP BY fid"))
def b_assign(spark, sf):
    return process.nearest_centre(geo_orders(spark, sf), [(s[1], s[2], s[3]) for s in R.SITES]).select("fid", "centre")


# gift wrapping: from the lowest corner always the point that has no other to its right, the farthest of a line
_CROSS = "(p.x - h.x) * (q.y - h.y) - (p.y - h.y) * (q.x - h.x)"
_FAR = "(q.x - h.x) * (q.x - h.x) + (q.y - h.y) * (q.y - h.y) > (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y)"
_HULL_SQL = (
    "hull(city, seq, x, y) AS (SELECT city, 0, min(x), arg_min(y, (x, y)) FROM places GROUP BY city UNION ALL "
    "SELECT h.city, h.seq + 1, p.x, p.y FROM hull h JOIN places p ON p.city = h.city AND (p.x <> h.x OR p.y <> h.y) "
    "JOIN (SELECT city, min(x) AS x0, arg_min(y, (x, y)) AS y0 FROM places GROUP BY city) s ON s.city = h.city "
    "WHERE h.seq < 1000 AND (p.x <> s.x0 OR p.y <> s.y0) AND NOT EXISTS (SELECT 1 FROM places q WHERE q.city = h.city AND (q.x <> h.x OR q.y <> h.y) "
    f"AND ({_CROSS} < 0 OR ({_CROSS} = 0 AND {_FAR}))))")


@query("b_hull", with_ctes(
    "geo_orders", "SELECT city, CAST(seq AS BIGINT) AS seq, x, y FROM hull", "places AS (SELECT DISTINCT city, lon AS x, lat AS y FROM geo_orders)", _HULL_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def b_hull(spark, sf):
    return clusters.convex_hulls(geo_orders(spark, sf), "city")


@query("b_dbscan", with_ctes(
    "geo_events", "SELECT e.fid, CAST(coalesce(c.cluster, -1) AS BIGINT) AS cluster, e.fid IN (SELECT fid FROM core) AS core FROM geo_events e LEFT JOIN "
    "(SELECT fid, min(label) AS cluster FROM (SELECT fid, label FROM named UNION ALL SELECT n.b, label FROM near n JOIN named m ON m.fid = n.a) GROUP BY fid) c ON c.fid = e.fid",
    "near AS (SELECT a.fid AS a, b.fid AS b FROM geo_events a JOIN geo_events b ON b.lon BETWEEN a.lon - 0.081e0 AND a.lon + 0.081e0 AND b.lat BETWEEN a.lat - 0.081e0 AND a.lat + 0.081e0 "
    "WHERE (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= 0.08e0 * 0.08e0)",
    "core AS (SELECT a AS fid FROM near GROUP BY a HAVING count(*) >= 4)",
    "links AS (SELECT a, b FROM near WHERE a <> b AND a IN (SELECT fid FROM core) AND b IN (SELECT fid FROM core))",
    "reach(fid, label) AS (SELECT fid, fid FROM core UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.fid WHERE r.label < l.b)",
    "named AS (SELECT fid, min(label) AS label FROM reach GROUP BY fid)").replace("WITH ", "WITH RECURSIVE ", 1))
def b_dbscan(spark, sf):
    return clusters.density_clusters(geo_events(spark, sf), 0.08, 4).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


@query("b_time_interval", with_ctes(
    "segs", "SELECT track, fid1 FROM segs WHERE t1 <= TIMESTAMP '2024-01-10 13:00:00' AND t2 >= TIMESTAMP '2024-01-10 12:00:00'"))
def b_time_interval(spark, sf):
    from datetime import datetime
    lo, hi = ntz(datetime(2024, 1, 10, 12)), ntz(datetime(2024, 1, 10, 13))
    return process.meeting_interval(stored_segments(spark, sf), "t1", "t2", lo, hi).select("track", "fid1")


@query("b_pixel_thin", with_ctes(
    "geo_events", f"SELECT px, py, min(fid) AS fid, arg_min(lon, fid) AS lon, arg_min(lat, fid) AS lat FROM (SELECT *, CAST(least(floor((lon-({_BOX[0]!r}e0))/70e0*256e0), 255) AS BIGINT) AS px, "
    f"CAST(least(floor((65e0-lat)/25e0*128e0), 127) AS BIGINT) AS py FROM geo_events WHERE {_IN_BOX_SQL}) GROUP BY px, py"))
def b_pixel_thin(spark, sf):
    return process.thin_to_pixels(geo_events(spark, sf), _BOX, 256, 128)


@query("b_attr_projection", with_ctes("geo_events", f"SELECT fid, event_type FROM geo_events WHERE {_IN_BOX_SQL}"))
def b_attr_projection(spark, sf):
    return _boxed(spark, sf).select("fid", "event_type")


@query("b_attr_index", with_ctes("geo_orders", "SELECT 'full' AS kind, fid, price FROM geo_orders WHERE priority = '2-HIGH' UNION ALL SELECT 'join', fid, price FROM geo_orders WHERE priority = '2-HIGH'"))
def b_attr_index(spark, sf):
    orders = geo_orders(spark, sf)
    full, keys = scratch_dir(spark, "by-priority"), scratch_dir(spark, "priority-keys")
    process.write_attribute_index(orders, full, "priority")
    process.write_attribute_index(orders, keys, "priority", full=False)
    a = process.lookup_full(spark, full, "priority", "2-HIGH").select(F.lit("full").alias("kind"), "fid", "price")
    b = process.lookup_join(spark, keys, orders, "priority", "2-HIGH").select(F.lit("join").alias("kind"), "fid", "price")
    return a.unionByName(b)


@query("b_text_ngram", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'art#00000001') OR contains(lower(p_name), 'blue')")
def b_text_ngram(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    index = process.ngram_index(parts, "p_name", "p_partkey")
    found = [process.ngram_search(parts, index, "p_name", p, "p_partkey") for p in ("art#00000001", "blue")]
    return found[0].unionByName(found[1]).distinct()
