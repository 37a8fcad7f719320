"""Features with an extent at rest: a row in the folder of every grid cell it meets, and reads that prune folders.

Folders are ``period`` (of the feature's time) and the column ``zx`` and row ``zy`` of a coarse grid. A read asks a rectangle
of cells and a range of periods; an extent in several of the cells asked is taken from the one that holds the lower left corner
of the common part, so no ``distinct`` and no shuffle is needed. Extents without a box or time have folders of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from waymark.functions import cells
from waymark.functions.times import TimeSpan, in_span
from waymark.sources.layout import _period_of

_FOLDERS = ("period", "zx", "zy")


def write_extents(df: DataFrame, path: str, box: Sequence[Column], time_col: str, period: str = "week", level: int = 3, mode: str = "append") -> None:
    """Write extents once per cell they meet. One shuffle by folder ranges; a folder of many rows is split by its rows' hash."""
    cell = F.explode_outer(cells.box_cells(*box, level))
    placed = df.withColumn("_c", cell).withColumn("period", cells.period_number(F.col(time_col), period)).withColumn("zx", F.col("_c.cx").cast("int")).withColumn(
        "zy", F.col("_c.cy").cast("int")).drop("_c")
    spread = placed.withColumn("_row", F.xxhash64(*df.columns)).repartitionByRange(*_FOLDERS, "_row").drop("_row")
    spread.sortWithinPartitions(*_FOLDERS).write.mode(mode).partitionBy(*_FOLDERS).parquet(path)


def read_extents(
    spark: SparkSession, path: str, schema: T.StructType, box: Sequence[Column], asked: Sequence[float] | None = None, span: TimeSpan | None = None,
    time_col: str = "t_start", period: str = "week", level: int = 3,
) -> DataFrame:
    """Extents that may meet the box ``asked`` in the span of time, each once. ``box`` are their bounds as written."""
    folders = T.StructType([T.StructField("period", T.LongType()), T.StructField("zx", T.IntegerType()), T.StructField("zy", T.IntegerType())])
    df = spark.read.schema(T.StructType([*schema.fields, *folders.fields])).parquet(path)
    own = cells.cell_x(box[0], level), cells.cell_y(box[1], level)
    if asked is None:
        df = df.filter(F.col("zx").isNull() | ((F.col("zx") == own[0]) & (F.col("zy") == own[1])))
    else:
        first = [cell(F.lit(float(v)), level) for cell, v in zip((cells.cell_x, cells.cell_y, cells.cell_x, cells.cell_y), asked, strict=True)]
        df = df.filter(F.col("zx").between(first[0], first[2]) & F.col("zy").between(first[1], first[3]))
        df = df.filter((F.col("zx") == F.greatest(own[0], first[0])) & (F.col("zy") == F.greatest(own[1], first[1])))
    if span is not None:
        if span.lo is not None:
            df = df.filter(F.col("period") >= _period_of(span.lo, period))
        if span.hi is not None:
            df = df.filter(F.col("period") <= _period_of(span.hi, period))
        if span.lo is not None or span.hi is not None:
            df = df.filter(in_span(F.col(time_col), TimeSpan(span.lo, span.hi, True)))
    return df.drop(*_FOLDERS)
