"""Other input forms: fixed width, JSON, XML and CSV dialects, each from a column of text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def fixed_width(lines: DataFrame, columns: Mapping[str, tuple[int, int, str]], value: str = "value") -> DataFrame:
    """Columns by (start counted from 1, length, type)."""
    return lines.select(*[
        F.trim(F.substring(value, start, length)).try_cast(kind).alias(name) for name, (start, length, kind) in columns.items()])


def json_records(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    return lines.select(F.from_json(value, schema).alias("_r")).select("_r.*")


def xml_records(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    return lines.select(F.from_xml(value, schema).alias("_r")).select("_r.*")


def csv_records(lines: DataFrame, schema: str, value: str = "value", **dialect) -> DataFrame:
    return lines.select(F.from_csv(value, schema, dialect).alias("_r")).select("_r.*")
