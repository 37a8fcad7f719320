"""Structured Streaming over feature tables.

Sources are folders or files of Parquet; every sink is a folder, and offsets, state and output live below
the shared checkpoint folder, so a lost executor or a restart goes on from the last commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.functions import cells
from waymark.operators.windows import WindowSet, points_in_windows
from waymark.session import scratch_dir
from waymark.sources.layout import with_layout
from waymark.streaming.keyed import KeyedTable


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append all that is there now and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.outputMode("append").trigger(availableNow=True).start()


def drain(stream: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run an append stream to its end and read its output."""
    spark = stream.sparkSession
    base = scratch_dir(spark, purpose)
    append_to(stream, base + "/out", base + "/checkpoint", partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/out")


def drain_updates(stream: DataFrame, keys: list[str], purpose: str, every: int = 16) -> DataFrame:
    """Run a stream of changed rows to its end; the last row of every key, one each."""
    spark = stream.sparkSession
    base = scratch_dir(spark, purpose)
    table = KeyedTable(spark, base + "/table", keys, stream.schema, every)
    stream.writeStream.outputMode("update").foreachBatch(table.save).option("checkpointLocation", base + "/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    table.compact()
    return table.read()


def geofence(points: DataFrame, windows: WindowSet, time_col: str = "ts") -> DataFrame:
    """Stream of points with the windows each falls in; the window tables are static."""
    return points_in_windows(points, windows, time_col)


def latest(points: DataFrame, key: str, time_col: str, columns: list[str], purpose: str = "latest", every: int = 16) -> DataFrame:
    """Latest row by key. The state holds one row per key, the sink takes the keys that a batch changed and is compacted."""
    order = [time_col, *[c for c in columns if c != time_col]]
    newest = points.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select(key, "v.*")
    return drain_updates(newest, [key], purpose, every)


def cell_counts(points: DataFrame, level: int, window: str, lateness: str, time_col: str = "ts") -> DataFrame:
    """Count per grid cell and tumbling window; a window comes out once the watermark passes its end and
    rows later than that are dropped."""
    return (
        points.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", lateness)
        .groupBy(F.window("_t", window).alias("w"), cells.cell_x(F.col("lon"), level).alias("cx"), cells.cell_y(F.col("lat"), level).alias("cy"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "cx", "cy", "n")
    )


def all_cell_counts(points: DataFrame, level: int, window: str, lateness: str, time_col: str = "ts", every: int = 16) -> DataFrame:
    """The same of a source that ends: the windows that are still open at its end come out, too, each window and cell once.

    Counts go to the sink as they change, so none waits for a watermark; rows behind the watermark are dropped as before.
    """
    return drain_updates(cell_counts(points, level, window, lateness, time_col), ["start", "end", "cx", "cy"], "all-cells", every)


def ingest(points: DataFrame, path: str, checkpoint: str, time_col: str = "ts", period: str = "day") -> StreamingQuery:
    """Append a stream to the feature layout in period folders."""
    return append_to(with_layout(points, time_col, period), path, checkpoint, ["period"])
