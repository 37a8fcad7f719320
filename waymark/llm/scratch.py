"""Steps of an operator that are written to the shared folder and deleted once nothing reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import scratch_dir

BROADCAST_ROWS = 500_000


class Scratch:
    """A folder below the shared checkpoint folder for the written steps of one call."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, scratch_dir(spark, "steps"), 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def cut(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back."""
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all steps; DataFrames that read them are of no use any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: Column, how: str) -> DataFrame:
    """Join with a written table of short rows, broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)
