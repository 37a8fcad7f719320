"""Feature tables at rest: period folders, curve order, shards, and reads that prune them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.functions import cells, geo
from waymark.functions.times import TimeSpan, in_span


def shard(fid: Column, n: int) -> Column:
    """Hash shard number; the same feature always gets the same shard."""
    return (F.conv(F.substring(F.md5(fid.cast("string")), 1, 13), 16, 10).cast("bigint") % n).cast("int")


def round_robin_shard(n: int) -> Column:
    """Shard by position in the task's input."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")


def with_layout(df: DataFrame, time_col: str | None = "ts", period: str = "month", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add the curve key ``z2`` and, with a time column, the folder number ``period``."""
    out = df.withColumn("z2", cells.z2(F.col(lon), F.col(lat)))
    return out.withColumn("period", cells.period_number(F.col(time_col), period)) if time_col else out


def write_features(
    df: DataFrame, path: str, time_col: str | None = "ts", period: str = "month", mode: str = "append",
    shards: int | None = None, shard_kind: str = "hash", fid: str = "fid", cluster: bool = True,
) -> None:
    """Write a feature table.

    Rows are range-partitioned by (period, curve key): one shuffle, after which a task holds few periods and row-group
    statistics are selective; a period with many rows is split over many tasks. Without ``cluster`` each task writes
    its own rows, which is map-only but makes a file for every task and period.
    """
    out = with_layout(df, time_col, period)
    keys = (["period"] if time_col else []) + ["z2"]
    if shards:
        out = out.withColumn("shard", shard(F.col(fid), shards) if shard_kind == "hash" else round_robin_shard(shards))
    if cluster:
        out = out.repartitionByRange(*keys, fid)
    folders = (["period"] if time_col else []) + (["shard"] if shards else [])
    writer = out.sortWithinPartitions(*folders, "z2").write.mode(mode)
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def register_table(spark: SparkSession, name: str, df: DataFrame, path: str) -> None:
    """Create the table of a feature type once, over its folder."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")


def read_window(
    spark: SparkSession, path: str, box=None, span: TimeSpan | None = None, time_col: str = "ts",
    period: str = "month", bits: int = 8,
) -> DataFrame:
    """Features of a box and a time span; folders are pruned by period, row groups by curve key."""
    df = spark.read.parquet(path)
    if span is not None:
        df = df.filter(in_span(F.col(time_col), span))
        if span.lo is not None:
            df = df.filter(F.col("period") >= _period_of(span.lo, period))
        if span.hi is not None:
            df = df.filter(F.col("period") <= _period_of(span.hi, period))
    if box is not None:
        ranges = joined_ranges(cells.cover(box, bits))
        df = df.filter(F.col("z2").between(ranges[0][0], ranges[-1][1]))
        any_range = F.lit(False)
        for low, high in ranges:
            any_range = any_range | F.col("z2").between(low, high)
        df = df.filter(any_range)
        df = df.filter(geo.in_box(F.col("lon"), F.col("lat"), box))
    return df


def joined_ranges(ranges: list[tuple[int, int]], most: int = 32) -> list[tuple[int, int]]:
    """At most ``most`` ascending ranges: those with the smallest gaps between them become one."""
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1], reverse=True)
    starts = [0, *sorted(gaps[:most - 1])]
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(starts, [*starts[1:], len(ranges)])]


def _period_of(instant, period: str) -> int:
    """Period number of one instant; must agree with :func:`cells.period_number`."""
    months = (instant.year - 1970) * 12 + instant.month - 1
    if period == "month":
        return months
    if period == "year":
        return instant.year - 1970
    from datetime import datetime
    return int((instant - datetime(1970, 1, 1)).total_seconds() // cells.PERIOD_SECONDS[period])
