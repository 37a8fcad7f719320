"""A table of one row per key that takes the changes of stream batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


class KeyedTable:
    """Changes go to a folder per batch; every ``every`` batches the folders and the table so far become a new table.

    Names carry the batch number. A batch that runs again after a failure writes its own folder again, and a table counts once
    it is whole, so neither a repeated batch nor a broken compaction changes what is read. Folders that a whole table
    holds are deleted after it; any that are left behind by a failure are older than the table and not read. A row is
    written about once per ``every`` batches and once per change, not once per batch.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType, every: int = 16):
        self.spark, self.path, self.keys, self.schema, self.every = spark, path.rstrip("/"), list(keys), schema, every
        self.values = [c for c in schema.names if c not in self.keys]

    def _folders(self) -> tuple[list[int], list[int]]:
        """Batch numbers of whole tables and of changes."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return [], []
        names = [(f.getPath(), f.getPath().getName()) for f in files.listStatus(root)]
        whole = [int(name.split("-")[1]) for path, name in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")) and name.startswith("table-")]
        changes = [int(name.split("-")[1]) for path, name in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")) and name.startswith("changes-")]
        return sorted(whole), sorted(changes)

    def save(self, batch: DataFrame, number: int) -> None:
        """The changes of a batch, at most one row per key: what ``foreachBatch`` calls."""
        batch.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/changes-{number}")
        if (number + 1) % self.every == 0:
            self.compact(number)

    def read(self, upto: int | None = None) -> DataFrame:
        """The newest row of every key, of batches up to a number."""
        whole, changes = self._folders()
        table = max((n for n in whole if upto is None or n <= upto), default=-1)
        newer = [n for n in changes if n > table and (upto is None or n <= upto)]
        read = lambda name: self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
        if not newer:
            return read(f"table-{table}") if table >= 0 else self.spark.createDataFrame([], self.schema)
        rows = None
        for name, number in [*([(f"table-{table}", table)] if table >= 0 else []), *[(f"changes-{n}", n) for n in newer]]:
            part = read(name).withColumn("_batch", F.lit(number).cast("bigint"))
            rows = part if rows is None else rows.unionByName(part)
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), "_batch").alias("_v"))
        return newest.select(*self.keys, "_v.*").select(*self.schema.names)

    def compact(self, number: int | None = None) -> None:
        """One row per key of all batches up to a number, as a new table; what it holds is deleted."""
        whole, changes = self._folders()
        newest = max((n for n in changes if number is None or n <= number), default=-1)
        if newest < 0:
            return
        if newest not in whole:  # else the batch ran again behind a whole table
            self.read(newest).write.mode("overwrite").parquet(f"{self.path}/table-{newest}")
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in [f"table-{n}" for n in whole if n < newest] + [f"changes-{n}" for n in changes if n <= newest]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
