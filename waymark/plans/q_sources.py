"""Sources and sinks: each query writes given data in the outside form and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.parse import concat, to_date, to_double, to_int, to_point
from waymark.functions.times import during, in_span
from waymark.operators.windows import box_shape
from waymark.plans import regions as R
from waymark.plans.fixtures import geo_boxes, geo_events, geo_orders, run_results, table, with_ctes
from waymark.plans.registry import query
from waymark.plans.sqltext import num, span_literal
from waymark.session import scratch_dir
from waymark.sources import avro, converters, delimited, geojson, layout, nested_binary, synthetic, tables


@query("src_list_files")
def src_list_files(spark, sf):
    return delimited.list_files(spark, sf, "*.parquet", recursive=True).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def _write_delimited(spark, sf, path):
    fid = F.col("fid")
    geo_events(spark, sf).select(
        fid, F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t"), "event_type",
        F.when(fid % 100 == 7, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(fid % 100 == 9, "east").otherwise(F.col("lon").cast("string")).alias("lon"), F.col("lat").cast("string").alias("lat"),
        F.lit("").alias("tail"),
    ).write.option("header", True).option("sep", "\t").option("compression", "gzip").option("emptyValue", "").csv(path)


@query("src_delimited", with_ctes(
    "geo_events", "SELECT CAST(fid AS INTEGER) AS event_id, date_trunc('second', ts) AS day, event_type, "
    "CASE WHEN fid % 100 = 7 THEN -1e0 ELSE value END AS value, CASE WHEN fid % 100 = 9 THEN 0e0 ELSE lon END AS lon, "
    "CASE WHEN fid % 100 = 9 THEN 0e0 ELSE lat END AS lat, 'events' AS type_name FROM geo_events"))
def src_delimited(spark, sf):
    path = scratch_dir(spark, "delimited")
    _write_delimited(spark, sf, path)
    features = delimited.read_delimited(spark, path, {
        "event_id": lambda f: to_int(f[1], "sentinel"),
        "day": lambda f: to_date(concat(f[2], f[3]), "yyyy-MM-ddHH:mm:ss", "sentinel"),
        "event_type": lambda f: f[4], "value": lambda f: to_double(f[5], "sentinel"),
        "the_geom": lambda f: to_point(f[6], f[7], "sentinel"),
    }, sep="\t", drop=1, type_name="events", glob="*.csv.gz")
    return features.select("event_id", "day", "event_type", F.nanvl("value", F.lit(-1.0)).alias("value"),
                           "the_geom.lon", "the_geom.lat", "type_name")


@query("src_skip_bad_files", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def src_skip_bad_files(spark, sf):
    events, path = table(spark, sf, "events"), scratch_dir(spark, "mixed")
    events.write.parquet(path + "/good")
    events.select(F.col("props").alias("value")).write.text(path + "/bad")  # not Parquet
    return (
        spark.read.schema(events.schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        .parquet(path + "/good", path + "/bad").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    )


@query("src_partitioning", "SELECT 16 AS partitions, count(*) AS n FROM events")
def src_partitioning(spark, sf):
    spread = table(spark, sf, "events").select("event_id").repartition(16)
    return spread.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(
        F.count("*").cast("int").alias("partitions"), F.sum("n").alias("n"))


def _box_tracks(spark, sf):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    return geo_boxes(spark, sf).select(
        F.col("fid").cast("string").alias("fid"), ring.alias("points"),
        (F.lit(5) + (F.col("fid") % 50 == 0).cast("int")).alias("num_track_points"), F.col("day").alias("time_stamp"),
        F.col("city").alias("key"), (2 * (F.col("xmax") - F.col("xmin") + F.col("ymax") - F.col("ymin"))).alias("total_distance"))


def _decoded(spark, sf, form=""):
    path = scratch_dir(spark, "tracks") + form
    nested_binary.write_collections(nested_binary.encode_tracks(_box_tracks(spark, sf)), path)
    return nested_binary.decode_tracks(nested_binary.read_collections(spark, path))


_NESTED_SQL = with_ctes(
    "geo_boxes", "SELECT CAST(fid AS VARCHAR) AS fid, xmin, ymin, xmax, ymax, 5 + CAST(fid % 50 = 0 AS INTEGER) AS num_track_points, "
    "day AS time_stamp, city AS key, 2*(xmax-xmin+ymax-ymin) AS total_distance FROM geo_boxes")


@query("src_nested_binary", _NESTED_SQL)
def src_nested_binary(spark, sf, form=""):
    return _decoded(spark, sf, form).withColumn("box", geo.envelope(F.col("points"))).select(
        "fid", "box.*", "num_track_points", "time_stamp", "key", "total_distance")


@query("src_nested_avro", _NESTED_SQL)
def src_nested_avro(spark, sf):
    """The same from Avro container files."""
    return src_nested_binary(spark, sf, ".avro")


@query("src_track_validation", with_ctes(
    "geo_orders", "SELECT CAST(fid AS VARCHAR) AS fid, 5 AS decoded, 6 AS stored FROM geo_orders WHERE fid % 50 = 0"))
def src_track_validation(spark, sf):
    return nested_binary.count_disagreements(_decoded(spark, sf)).select(
        "fid", F.size("points").alias("decoded"), F.col("num_track_points").alias("stored"))


@query("src_geojson", with_ctes(
    "geo_boxes", "SELECT 'box-' || city || '-' || fid AS name, 'MultiPolygon' AS kind, xmin, ymin, xmax, ymax, 4 AS n_edges FROM geo_boxes"))
def src_geojson(spark, sf):
    path = scratch_dir(spark, "geojson")
    name = F.concat_ws(" ", F.lit("box"), F.col("city"), F.col("fid").cast("string"))
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    geo_boxes(spark, sf).select(geojson.collection_json(geojson.box_feature_json(name, *box)).alias("value")).write.text(path)
    return geojson.read_geojson(spark, path, "name", multiline=False).withColumn(
        "box", geojson.polygon_envelope(F.col("polygons"))).select("name", "kind", "box.*", F.size("edges").alias("n_edges"))


@query("snk_features", with_ctes(
    "geo_events", "SELECT fid, ts, event_type, lon, lat FROM geo_events WHERE "
    f"lon BETWEEN {num(R.BEIJING_BOX[0])} AND {num(R.BEIJING_BOX[2])} AND lat BETWEEN {num(R.BEIJING_BOX[1])} AND {num(R.BEIJING_BOX[3])} "
    f"AND {span_literal('ts', during('2024-01-08', '2024-01-21'))}"))
def snk_features(spark, sf):
    """Written map-only in day folders, then read back with folder and curve pruning."""
    path = scratch_dir(spark, "features")
    layout.write_features(geo_events(spark, sf), path, period="day")
    return layout.read_window(spark, path, R.BEIJING_BOX, during("2024-01-08", "2024-01-21"), period="day").select(
        "fid", "ts", "event_type", "lon", "lat")


@query("snk_layout", with_ctes(
    "geo_orders", "SELECT extract(year FROM day) - 1970 AS period, count(*) AS n, CAST(sum(fid) AS BIGINT) AS fids, "
    "TRUE AS sharded FROM geo_orders GROUP BY 1"))
def snk_layout(spark, sf):
    """Space and time layout, clustered, with hash shards."""
    path = scratch_dir(spark, "layout")
    layout.write_features(geo_orders(spark, sf), path, "day", "year", shards=4, cluster=True)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("period").cast("bigint").alias("period")).agg(
        F.count("*").alias("n"), F.sum("fid").alias("fids"),
        F.min((F.col("shard") == layout.shard(F.col("fid"), 4)).cast("int")).cast("boolean").alias("sharded"))


@query("snk_register_schema", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def snk_register_schema(spark, sf):
    events = geo_events(spark, sf)
    path = scratch_dir(spark, "registered")
    name = "waymark_" + path.rsplit("-", 1)[-1]
    for _ in range(2):  # the second call finds the table
        layout.register_table(spark, name, events, path)
    events.write.insertInto(name)
    return spark.table(name).groupBy("event_type").agg(F.count("*").alias("n"))


@query("snk_run_results", with_ctes(
    "runs", "SELECT test AS is_test, system, count(*) AS n, CAST(sum(duration) AS BIGINT) AS duration FROM runs GROUP BY test, system"))
def snk_run_results(spark, sf):
    path, runs = scratch_dir(spark, "runs"), run_results(spark, sf)
    for system in ("A", "B"):
        tables.save_runs(runs.filter(F.col("system") == system), path)
    return tables.read_runs(spark, path).groupBy("is_test", "system").agg(
        F.count("*").alias("n"), F.sum("duration").alias("duration"))


_RUN_COLUMNS = "uuid, \"queryName\", system, \"clusterId\", \"startTime\", \"endTime\", duration, \"timeAtFirstResult\", result, test"


def _csv_trip(spark, sf):
    path = scratch_dir(spark, "csv")
    # a quote and a line break in the name must survive and vanish respectively
    dirty = run_results(spark, sf).withColumn("queryName", F.concat(F.lit('"q" '), "queryName", F.lit("\n")))
    tables.export_csv(dirty, path)
    return path


@query("snk_csv_export", with_ctes("runs", f"SELECT {_RUN_COLUMNS.replace(chr(34) + 'queryName' + chr(34), chr(39) + chr(34) + 'q' + chr(34) + ' ' + chr(39) + ' || ' + chr(34) + 'queryName' + chr(34) + ' AS ' + chr(34) + 'queryName' + chr(34))} FROM runs"))
def snk_csv_export(spark, sf):
    return tables.read_result_csv(spark, _csv_trip(spark, sf))


@query("src_result_csv", with_ctes("runs", "SELECT system, count(*) AS n, CAST(sum(result) AS BIGINT) AS result, CAST(sum(\"startTime\") AS BIGINT) AS started FROM runs GROUP BY system"))
def src_result_csv(spark, sf):
    path = scratch_dir(spark, "csv")
    tables.export_csv(run_results(spark, sf), path)
    return tables.read_result_csv(spark, path).groupBy("system").agg(
        F.count("*").alias("n"), F.sum("result").alias("result"), F.sum("startTime").alias("started"))


@query("snk_result_csv", with_ctes("runs", "SELECT \"queryName\", duration, result FROM runs WHERE result >= 1000 AND result < 1200"))
def snk_result_csv(spark, sf):
    path = scratch_dir(spark, "filtered")
    run_results(spark, sf).filter("result >= 1000 AND result < 1200").select("queryName", "duration", "result").write.option(
        "header", True).csv(path)
    return spark.read.schema("queryName string, duration bigint, result bigint").option("header", True).csv(path)


@query("snk_geojson_grid", with_ctes(
    "geo_orders", "SELECT cx || '-' || cy AS name, n, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[' || "
    "'[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']' || "
    "']]},\"properties\":{\"name\":\"' || cx || '-' || cy || '\"}}' AS feature FROM (SELECT cx, cy, n, cx*11.25e0-180e0 AS x0, cy*5.625e0-90e0 AS y0, "
    "(cx+1)*11.25e0-180e0 AS x1, (cy+1)*5.625e0-90e0 AS y1 FROM (SELECT CAST(floor((lon+180e0)/360e0*32e0) AS BIGINT) AS cx, "
    "CAST(floor((lat+90e0)/180e0*32e0) AS BIGINT) AS cy, count(*) AS n FROM geo_orders GROUP BY ALL))"))
def snk_geojson_grid(spark, sf):
    """Occupied grid cells as GeoJSON features, a feature per row for ``write.text``."""
    from waymark.functions import cells
    grid = geo_orders(spark, sf).groupBy(cells.cell_x(F.col("lon"), 5).alias("cx"), cells.cell_y(F.col("lat"), 5).alias("cy")).agg(
        F.count("*").alias("n"))
    name = F.concat_ws("-", F.col("cx").cast("string"), F.col("cy").cast("string"))
    x0, y0 = F.col("cx") * 11.25 - 180.0, F.col("cy") * 5.625 - 90.0
    x1, y1 = (F.col("cx") + 1) * 11.25 - 180.0, (F.col("cy") + 1) * 5.625 - 90.0
    return grid.select(name.alias("name"), "n", geojson.box_feature_json(name, x0, y0, x1, y1).alias("feature"))


def _typed(spark, sf):
    events = geo_events(spark, sf).select(F.lit("geo-events").alias("type_name"), "fid", "lon", "lat", "city")
    orders = geo_orders(spark, sf).select(F.lit("geo-orders").alias("type_name"), "fid", "lon", "lat", "city")
    return events.unionByName(orders)


_TYPED_SQL = ("typed AS (SELECT 'geo-events' AS type_name, fid, lon, lat, city FROM geo_events UNION ALL "
              "SELECT 'geo-orders', fid, lon, lat, city FROM geo_orders)")


@query("cat_types", with_ctes("geo_events geo_orders", "SELECT DISTINCT type_name FROM typed", _TYPED_SQL))
def cat_types(spark, sf):
    return tables.list_types(_typed(spark, sf))


@query("cat_attributes", with_ctes("geo_events geo_orders", " UNION ALL ".join(
    f"SELECT type_name, '{c}' AS attribute, '{t}' AS type, count({c}) AS n FROM typed GROUP BY type_name"
    for c, t in [("fid", "bigint"), ("lon", "double"), ("lat", "double"), ("city", "string")]), _TYPED_SQL))
def cat_attributes(spark, sf):
    """Attributes of each type with the number of values present."""
    typed = _typed(spark, sf)
    listed = tables.list_attributes(typed)
    counts = typed.groupBy("type_name").agg(*[F.count(c).alias(c) for c, _ in listed])
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.lit(t).alias("type"), F.col(c).alias("n")) for c, t in listed])
    return counts.select("type_name", F.inline(rows))


@query("cat_counts", with_ctes("geo_events geo_orders", "SELECT type_name, count(*) AS n FROM typed GROUP BY type_name", _TYPED_SQL))
def cat_counts(spark, sf):
    return tables.count_types(_typed(spark, sf))


@query("b_converters", with_ctes(
    "geo_events", "SELECT f.form, fid, round(lon, 3) AS lon, event_type FROM geo_events, "
    "(VALUES ('fixed'), ('json'), ('xml'), ('csv')) f(form)"))
def b_converters(spark, sf):
    lon = F.format_string("%.3f", "lon")
    events = geo_events(spark, sf)
    fid = F.col("fid").cast("string")
    fixed = events.select(F.concat(F.lpad(fid, 20, " "), F.lpad(lon, 10, " "), F.col("event_type")).alias("value"))
    as_json = events.select(F.to_json(F.struct("fid", lon.cast("double").alias("lon"), "event_type")).alias("value"))
    as_xml = events.select(F.concat(F.lit("<r><fid>"), fid, F.lit("</fid><lon>"), lon, F.lit("</lon><event_type>"),
                                    F.col("event_type"), F.lit("</event_type></r>")).alias("value"))
    as_csv = events.select(F.concat_ws(";", fid, lon, F.concat(F.lit("'"), "event_type", F.lit("'"))).alias("value"))
    schema = "fid bigint, lon double, event_type string"
    parts = {
        "fixed": converters.fixed_width(fixed, {"fid": (1, 20, "bigint"), "lon": (21, 10, "double"), "event_type": (31, 20, "string")}),
        "json": converters.json_records(as_json, schema), "xml": converters.xml_records(as_xml, schema),
        "csv": converters.csv_records(as_csv, schema, sep=";", quote="'"),
    }
    out = None
    for form, df in parts.items():
        df = df.select(F.lit(form).alias("form"), "fid", "lon", "event_type")
        out = df if out is None else out.unionByName(df)
    return out


@query("b_export", with_ctes(
    "geo_orders", "SELECT fid, round(lon, 6) AS lon, round(lat, 6) AS lat FROM geo_orders WHERE city = 'Paris'"))
def b_export(spark, sf):
    """A filter exported as GeoJSON text and read back."""
    path = scratch_dir(spark, "export")
    paris = geo_orders(spark, sf).filter(F.col("city") == "Paris")
    feature = geojson.point_feature_json(F.col("fid").cast("string"), F.col("lon"), F.col("lat"))
    paris.select(geojson.collection_json(feature).alias("value")).write.text(path)
    return geojson.read_geojson(spark, path, "name", multiline=False).select(
        F.col("name").cast("bigint").alias("fid"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_EXPORT_SQL = with_ctes("geo_orders", "SELECT fid, day, city, lon, lat FROM geo_orders WHERE city = 'Paris' OR fid % 10 = 0")


def _exported(spark, sf):
    return geo_orders(spark, sf).filter((F.col("city") == "Paris") | (F.col("fid") % 10 == 0)).select("fid", "day", "city", "lon", "lat")


@query("b_export_csv", _EXPORT_SQL)
def b_export_csv(spark, sf):
    """A filter exported as CSV and read back."""
    path = scratch_dir(spark, "export")
    _exported(spark, sf).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("fid bigint, day timestamp_ntz, city string, lon double, lat double").csv(path)


@query("b_export_avro", _EXPORT_SQL)
def b_export_avro(spark, sf):
    """A filter exported as Avro and read back with the schema of the files."""
    path = scratch_dir(spark, "export") + ".avro"
    rows = _exported(spark, sf).withColumn("day", F.unix_millis(F.col("day").cast("timestamp")))
    avro.register(spark)
    rows.write.format("avro_files").mode("append").save(path)
    return spark.read.format("avro_files").load(path).withColumn("day", F.timestamp_millis("day").cast("timestamp_ntz"))


# ---- generated features --------------------------------------------------------------------------

def _tasks(spark, sf):
    """An instruction per supplier: its site, two tasks, five points each."""
    from waymark.plans.fixtures import _site
    supplier = table(spark, sf, "supplier").select("s_suppkey", _site(F.col("s_suppkey")).alias("site"), F.lit(2).alias("tasks"), F.lit(5).alias("n"))
    return synthetic.expand_instructions(supplier, "s_suppkey")


_TASKS_SQL = "tasks AS (SELECT s_suppkey, t.task, s_suppkey || '-' || t.task AS seed, slon, slat FROM supplier JOIN sites ON site_id = s_suppkey % 12, (VALUES (1), (2)) t(task))"


@query("gen_instruction", with_ctes("sites", "SELECT s_suppkey, task, seed FROM tasks", _TASKS_SQL))
def gen_instruction(spark, sf):
    return _tasks(spark, sf).select("s_suppkey", "task", "seed")


def _u(stream, *keys):
    text = "seed || '|" + stream + "|' || " + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)/4503599627370496e0)"


def _g(stream, *keys):
    import math
    return f"(sqrt(-2e0*ln(1e0-{_u(stream + '/a', *keys)}))*cos({2 * math.pi!r}*{_u(stream + '/b', *keys)}))"


def _l(stream, length):
    return " || ".join(
        f"chr(CAST(CAST(('0x' || substr(md5(seed || '|{stream}/{i // 8}|' || i), {i % 8 * 4 + 1}, 4)) AS BIGINT) % 26 + 65 AS INTEGER))".replace("|' || i)", "|' || t.i)")
        for i in range(length))


@query("src_synthetic", with_ctes(
    "sites", "SELECT seed || '/i=' || t.i AS fid, round(-10e0 + " + _u("lng", "t.i") + "*20e0, 6) AS lon, round(slat + " + _g("lat", "t.i") + "*0.5e0, 6) AS lat, "
    "epoch_ms(CAST(floor(1.0e12 + " + _u("time", "t.i") + "*(1.1e12-1.0e12)) AS BIGINT)) AS \"when\", "
    f"{_l('who', 3)} AS who, {_l('what', 7)} AS what, {_l('why', 13)} AS why FROM tasks, (SELECT unnest(range(5)) AS i) t", _TASKS_SQL))
def src_synthetic(spark, sf):
    points = synthetic.generate_points(
        _tasks(spark, sf), ("uniform", -10, 10), ("normal", F.col("site.lat"), 0.5), ("uniform", 1.0e12, 1.1e12), "n")
    return points.select("fid", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "when", "who", "what", "why")


@query("gen_extent", with_ctes(
    "sites", "SELECT seed || '/i=' || t.i || '/w=' || w.w AS fid, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, "
    "round(least(xmin + width, 180e0), 6) AS xmax, round(least(ymin + width, 90e0), 6) AS ymax FROM (SELECT *, 1e0 + w*2.5e0 AS width, "
    "-180e0 + " + _u("lng", "i", "w") + "*360e0 AS xmin, -90e0 + " + _u("lat", "i", "w") + "*180e0 AS ymin "
    "FROM tasks, (SELECT unnest(range(5)) AS i), (SELECT unnest(range(4)) AS w)) t, LATERAL (SELECT t.w AS w) w", _TASKS_SQL))
def gen_extent(spark, sf):
    boxes = synthetic.generate_extents(_tasks(spark, sf), ("uniform", -180, 180), ("uniform", -90, 90), 1.0, 11.0, 2.5, "n")
    return boxes.select("fid", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("src_synthetic_cities", with_ctes(
    "geo_orders", "SELECT fid, city, round(slon + " + _g("lng", "fid") + "*0.5e0, 6) AS lon, round(slat + " + _g("lat", "fid") + "*0.5e0, 6) AS lat "
    "FROM (SELECT o.fid, o.city, slon, slat, '7' AS seed FROM geo_orders o JOIN sites s ON s.city = o.city)"))
def src_synthetic_cities(spark, sf):
    """A point near a site for every running number, normal with 0.5 degrees, in shuffled order."""
    from waymark.functions.draws import normal
    from waymark.plans.fixtures import _site
    numbers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fid"), _site(F.col("o_custkey")).alias("site"))
    return numbers.select(
        "fid", "site.city", F.round(normal(7, "lng", F.col("site.lon"), 0.5, F.col("fid")), 6).alias("lon"),
        F.round(normal(7, "lat", F.col("site.lat"), 0.5, F.col("fid")), 6).alias("lat"))
