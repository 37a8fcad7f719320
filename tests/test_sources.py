"""Readers on small literal files."""

import gzip

import pytest
from pyspark.sql import functions as F

from waymark.functions.parse import to_date, to_double, to_int, to_point
from waymark.functions.times import during
from waymark.plans.fixtures import geo_events
from waymark.sources import delimited, geojson, layout, nested_binary, synthetic


def test_trajectory_files_drop_six_lines_each(spark, tmp_path):
    head = "".join(f"head {i}\n" for i in range(6))
    for name, rows in (("a.plt", ["39.9,116.3,0,492,39744.1,2008-10-23,02:53:04", "bad,116.3,0,x,1,2008-13-99,02:53:10"]), ("b.plt", ["40.0,116.4,0,1,2,2008-10-24,00:00:00,,"])):
        (tmp_path / name).write_text(head + "\n".join(rows) + "\n")
    with gzip.open(tmp_path / "c.plt.gz", "wt") as f:
        f.write(head + "41.0,117.0,0,9,9,2008-10-25,01:00:00\n")
    df = delimited.read_delimited(spark, str(tmp_path), delimited.trajectory_columns(), ",", drop=6, type_name="walks")
    rows = sorted((r.the_geom.lon, r.the_geom.lat, r.height, str(r.timestamp)) for r in df.collect())
    assert rows == [(0.0, 0.0, "x", "1969-12-31 23:59:59.999000"), (116.3, 39.9, "492", "2008-10-23 02:53:04"),
                    (116.4, 40.0, "1", "2008-10-24 00:00:00"), (117.0, 41.0, "9", "2008-10-25 01:00:00")]
    assert delimited.list_files(spark, str(tmp_path), "*.plt").count() == 2


def test_event_table(spark, tmp_path):
    fields = [str(i) for i in range(1, 59)]
    fields[1], fields[53], fields[54], fields[4] = "19790101", "48.5", "2.5", "1979.0"
    (tmp_path / "e.csv").write_text("\t".join(fields) + "\n")
    row = delimited.read_delimited(spark, str(tmp_path), delimited.event_columns(), "\t").first()
    assert (row.the_geom.lon, row.the_geom.lat, row.event_id, row.year) == (2.5, 48.5, 1, 4)
    assert (row.actor1_code, row.actor2_type3_code, row.quad_class, row.avg_tone, row.action_geo_featureid) == ("6", "25", "30", 35.0, "56")
    assert str(row.day) == "1979-01-01 00:00:00" and (row.actor1_geom.lon, row.actor2_geom.lat) == (41.0, 47.0)


def test_bad_values(spark):
    df = spark.createDataFrame([("7", "1.5", "20240102"), ("x", "", "20241302"), (None, "y", None)], "a string, b string, d string")
    rows = df.select(to_int(F.col("a"), "sentinel").alias("i"), to_double(F.col("b"), "sentinel").alias("x"), to_point(F.col("a"), F.col("b"), "sentinel").alias("p"),
                     to_date(F.col("d"), "yyyyMMdd", "sentinel").alias("t"), to_int(F.col("a")).alias("n")).collect()
    assert [r.i for r in rows] == [7, -2147483648, -2147483648] and [r.n for r in rows] == [7, None, None]
    assert rows[0].x == 1.5 and rows[1].x != rows[1].x and tuple(rows[1].p) == (0.0, 0.0) and tuple(rows[0].p) == (7.0, 1.5)
    assert [str(r.t) for r in rows] == ["2024-01-02 00:00:00"] + ["1969-12-31 23:59:59.999000"] * 2
    with pytest.raises(ValueError):
        to_int(F.col("a"), "zero")


def test_geojson_kinds(spark, tmp_path):
    (tmp_path / "f.json").write_text("""{"type": "FeatureCollection", "features": [
      {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}, "properties": {"nom": "A B", "code": 3}},
      {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}, "properties": {"nom": "C"}},
      {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.5, 3]}, "properties": {"nom": "D"}}]}""")
    rows = {r.name: r for r in geojson.read_geojson(spark, str(tmp_path), "nom").collect()}
    assert rows["A-B"].kind == "MultiPolygon" and len(rows["A-B"].polygons) == 1 and len(rows["A-B"].edges) == 8
    assert len(rows["C"].polygons) == 2 and len(rows["C"].edges) == 6
    assert (rows["D"].lon, rows["D"].lat, rows["D"].polygons) == (2.5, 3.0, None)


def test_binary_tracks(spark):
    tracks = spark.createDataFrame(
        [("a", [{"x": 1.5, "y": -2.0}, {"x": 3.0, "y": 4.0}], 2, "2015-01-01 00:00:00", "k1", 12.25), ("b", [{"x": 0.0, "y": 0.0}] * 2, 3, "1969-12-31 23:59:59", "k2", 0.0)],
        "fid string, points array<struct<x:double,y:double>>, num_track_points int, t string, key string, total_distance double").withColumn(
        "time_stamp", F.col("t").cast("timestamp_ntz")).drop("t")
    back = nested_binary.decode_tracks(nested_binary.encode_tracks(tracks))
    columns = ["fid", "points", "num_track_points", "time_stamp", "key", "total_distance"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, tracks.select(columns).collect()))
    assert [r.fid for r in nested_binary.count_disagreements(back).collect()] == ["b"]
    two = nested_binary.encode_tracks(tracks).withColumn("simpleFeatureCollection", F.concat("simpleFeatureCollection", "simpleFeatureCollection"))
    with pytest.raises(Exception, match="exactly one feature"):
        nested_binary.decode_tracks(two).collect()


def test_layout_prunes_folders(spark, sf, tmp_path):
    path = str(tmp_path / "features")
    layout.write_features(geo_events(spark, sf), path, period="day", cluster=True)
    read = layout.read_window(spark, path, (115, 39, 118, 42), during("2024-01-08", "2024-01-10"), period="day")
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = read._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "period" in partition_filters and "GreaterThanOrEqual(z2" in plan


def test_draws_do_not_depend_on_partitions(spark):
    base = spark.range(40).select(F.col("id").alias("k"), F.lit(2).alias("tasks"), F.lit(3).alias("n"))
    def points(df):
        out = synthetic.generate_points(synthetic.expand_instructions(df, "k"), ("normal", 0, 1), ("uniform", -5, 5), ("fixed", 1e12), "n")
        return sorted(map(str, out.select("fid", "lon", "lat", "when", "who", "why").collect()))
    one = points(base.repartition(1))
    assert one == points(base.repartition(7)) and len(one) == 240
    stats = synthetic.generate_points(synthetic.expand_instructions(spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("tasks"), F.lit(5).alias("n")), "k"),
                                      ("normal", 3, 2), ("uniform", -5, 5), ("fixed", 0), "n").agg(F.avg("lon"), F.stddev("lon"), F.min("lat"), F.max("lat")).first()
    assert abs(stats[0] - 3) < 0.1 and abs(stats[1] - 2) < 0.1 and -5 <= stats[2] < -4.9 and 4.9 < stats[3] <= 5
