"""GeoJSON feature collections in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.functions import geo

COLLECTION_SCHEMA = (
    "type string, features array<struct<type: string, geometry: struct<type: string, coordinates: string>, "
    "properties: map<string, string>>>"
)
_RING = "array<array<double>>"


def read_geojson(spark: SparkSession, path: str, name_property: str, multiline: bool = True) -> DataFrame:
    """``name, kind, lon, lat, polygons, edges`` of every feature.

    A polygon is held as a multipolygon of one part. Blanks in names become ``-``. ``multiline`` reads one
    collection per file, otherwise one collection per line.
    """
    collections = spark.read.schema(COLLECTION_SCHEMA).option("multiLine", multiline).json(path)
    return parse_collections(collections, name_property)


def parse_collections(collections: DataFrame, name_property: str) -> DataFrame:
    feature = collections.select(F.explode("features").alias("f"))
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.when(kind == "Point", F.from_json(coords, "array<double>"))
    polygons = F.when(kind == "Polygon", F.array(F.from_json(coords, f"array<{_RING}>"))).when(
        kind == "MultiPolygon", F.from_json(coords, f"array<array<{_RING}>>"))
    as_points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    shaped = feature.select(
        F.replace(F.element_at("f.properties", name_property), F.lit(" "), F.lit("-")).alias("name"),
        F.when(kind == "Polygon", "MultiPolygon").otherwise(kind).alias("kind"),
        point.alias("_p"), F.transform(polygons, lambda poly: F.transform(poly, as_points)).alias("polygons"))
    return shaped.select("name", "kind", F.get("_p", F.lit(0)).alias("lon"), F.get("_p", F.lit(1)).alias("lat"),
                         "polygons", polygon_edges(F.col("polygons")).alias("edges"))


def polygon_edges(polygons: Column) -> Column:
    """Edges of all rings of a multipolygon column."""
    return F.flatten(F.transform(F.flatten(polygons), geo.ring_edges))


def polygon_envelope(polygons: Column) -> Column:
    return geo.envelope(F.flatten(F.flatten(polygons)))


def box_feature_json(name: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box as GeoJSON feature text."""
    corner = lambda x, y: F.array(x, y)
    ring = F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(name.alias("name")).alias("properties")))


def point_feature_json(name: Column, lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(name.alias("name")).alias("properties")))


def collection_json(feature: Column) -> Column:
    """A one-feature collection, one per line of a text file."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
