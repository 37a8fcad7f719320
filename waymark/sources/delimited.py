"""Delimited text files to typed features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.functions.parse import Fields, concat, to_date, to_double, to_int, to_point

ColumnMap = Mapping[str, Callable[[Fields], Column]]


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of the files below a path; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def _drop_head(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task reads its splits one after the other and in order; only a split that starts at byte 0
        # holds the head of a file. The count carries over batch borders.
        seen: dict[str, int] = {}
        for batch in batches:
            keep = pd.Series(True, index=batch.index)
            for path, rows in batch[batch["start"] == 0].groupby("path", sort=False):
                left = n - seen.get(path, 0)
                if left > 0:
                    keep[rows.index[:left]] = False
                seen[path] = min(n, seen.get(path, 0) + len(rows))
            yield batch.loc[keep, ["value"]]
    return run


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], drop: int = 0, glob: str | None = None,
    recursive: bool = False, skip_bad_files: bool = False,
) -> DataFrame:
    """Column ``value`` with the lines of plain or gz text, without the first ``drop`` lines of each file."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if skip_bad_files:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    lines = reader.text(paths if isinstance(paths, str) else list(paths))
    if drop == 0:
        return lines
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return placed.mapInPandas(_drop_head(drop), "value string")


def map_columns(lines: DataFrame, columns: ColumnMap, sep: str, value: str = "value") -> DataFrame:
    """Split each line at a regular expression and build one column per entry of ``columns``.

    Trailing empty fields are kept, so that every field keeps its number.
    """
    fields = Fields(F.col("_f"))
    return lines.select(F.split(F.col(value), sep, -1).alias("_f")).select(
        *[make(fields).alias(name) for name, make in columns.items()])


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], columns: ColumnMap, sep: str = "\t", drop: int = 0,
    type_name: str | None = None, partitions: int | None = None, **options,
) -> DataFrame:
    """Features from delimited files. ``partitions`` spreads few large gz files over more tasks."""
    lines = read_lines(spark, paths, drop, **options)
    if partitions:
        lines = lines.repartition(partitions)
    features = map_columns(lines, columns, sep)
    return features.withColumn("type_name", F.lit(type_name)) if type_name else features


def _text(n: int):
    return lambda f: f[n]


def _int(n: int):
    return lambda f: to_int(f[n], "sentinel")


def _double(n: int):
    return lambda f: to_double(f[n], "sentinel")


def _point(x: int, y: int):
    return lambda f: to_point(f[x], f[y], "sentinel")


# The columns of the public event table in the order of the file, with their kind and field number
# (longitude and latitude for points).
EVENT_COLUMNS = [
    ("event_id", "int", 1),
    ("day", "day", 2),
    ("month_year", "int", 3),
    ("year", "int", 4),
    ("fraction_date", "double", 5),
    ("actor1_code", "text", 6),
    ("actor1_name", "text", 7),
    ("actor1_country_code", "text", 8),
    ("actor1_known_group_code", "text", 9),
    ("actor1_ethnic_code", "text", 10),
    ("actor1_religion1_code", "text", 11),
    ("actor1_religion2_code", "text", 12),
    ("actor1_type1_code", "text", 13),
    ("actor1_type2_code", "text", 14),
    ("actor1_type3_code", "text", 15),
    ("actor2_code", "text", 16),
    ("actor2_name", "text", 17),
    ("actor2_country_code", "text", 18),
    ("actor2_known_group_code", "text", 19),
    ("actor2_ethnic_code", "text", 20),
    ("actor2_religion1_code", "text", 21),
    ("actor2_religion2_code", "text", 22),
    ("actor2_type1_code", "text", 23),
    ("actor2_type2_code", "text", 24),
    ("actor2_type3_code", "text", 25),
    ("is_root_event", "text", 26),
    ("event_code", "text", 27),
    ("event_base_code", "text", 28),
    ("event_root_code", "text", 29),
    ("quad_class", "text", 30),
    ("goldstein_scale", "double", 31),
    ("num_mentions", "int", 32),
    ("num_sources", "int", 33),
    ("num_articles", "int", 34),
    ("avg_tone", "double", 35),
    ("actor1_geo_type", "int", 36),
    ("actor1_geo_fullname", "text", 37),
    ("actor1_geo_countrycode", "text", 38),
    ("actor1_adm1code", "text", 39),
    ("actor1_geom", "point", (41, 40)),
    ("actor1_geo_featureid", "text", 42),
    ("actor2_geo_type", "int", 43),
    ("actor2_geo_fullname", "text", 44),
    ("actor2_geo_countrycode", "text", 45),
    ("actor2_adm1code", "text", 46),
    ("actor2_geom", "point", (48, 47)),
    ("actor2_geo_featureid", "text", 49),
    ("action_geo_type", "int", 50),
    ("action_geo_fullname", "text", 51),
    ("action_geo_countrycode", "text", 52),
    ("action_adm1code", "text", 53),
    ("the_geom", "point", (55, 54)),
    ("action_geo_featureid", "text", 56),
]
_KINDS = {"text": _text, "int": _int, "double": _double, "point": lambda xy: _point(*xy), "day": lambda n: lambda f: to_date(f[n], "yyyyMMdd", "sentinel")}


def event_columns() -> dict[str, Callable[[Fields], Column]]:
    """The public event table: tab separated, 57 fields and more."""
    return {name: _KINDS[kind](place) for name, kind, place in EVENT_COLUMNS}


def trajectory_columns() -> dict[str, Callable[[Fields], Column]]:
    """Trajectory log files: comma separated, six head lines to drop."""
    return {
        "the_geom": _point(2, 1), "height": _text(4),
        "timestamp": lambda f: to_date(concat(f[6], f[7]), "yyyy-MM-ddHH:mm:ss", "sentinel"),
    }
