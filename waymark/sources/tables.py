"""Run-result tables, text exports and the catalog of feature types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RUN_SCHEMA = (
    "uuid string, queryName string, system string, clusterId string, startTime bigint, endTime bigint, "
    "duration bigint, timeAtFirstResult bigint, result bigint, test boolean"
)


def save_runs(runs: DataFrame, path: str) -> None:
    """Append runs; test runs and real runs go to different folders."""
    runs.withColumnRenamed("test", "is_test").write.mode("append").partitionBy("is_test").parquet(path)


def read_runs(spark: SparkSession, path: str, test: bool | None = None) -> DataFrame:
    runs = spark.read.parquet(path).withColumn("is_test", F.col("is_test").cast("boolean"))
    return runs if test is None else runs.filter(F.col("is_test") == test)


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Every field quoted, line breaks removed, quotes escaped with a backslash.

    Tasks write in parallel; ``one_file`` is for small results only.
    """
    texts = {c: F.regexp_replace(c, "[\r\n]+", "") for c, t in df.dtypes if t == "string"}
    out = df.withColumns(texts) if texts else df
    if one_file:
        out = out.repartition(1)
    out.write.option("header", True).option("quoteAll", True).option("escape", "\\").mode("append").csv(path)


def read_result_csv(spark: SparkSession, path: str, schema: str = RUN_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", "\\").csv(path)


def is_test_flag(option: Column) -> Column:
    """A run is a test unless the option says ``false``."""
    return F.when(option == "false", False).otherwise(True)


def is_loose_flag(option: Column) -> Column:
    """Loose only if the option says ``true``."""
    return F.when(option == "true", True).otherwise(False)


def list_types(features: DataFrame) -> DataFrame:
    return features.select("type_name").distinct()


def list_attributes(features: DataFrame) -> list[tuple[str, str]]:
    return [(c, t) for c, t in features.dtypes if c != "type_name"]


def count_types(features: DataFrame) -> DataFrame:
    return features.groupBy("type_name").agg(F.count("*").alias("n"))
