"""Sinks that may be replayed: each epoch owns its folder, so writing it again replaces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.sources.shared import nothing


class EpochTable:
    """An append-only table as one folder per epoch, and, with ``day_of``, one per day of that time within."""

    def __init__(self, spark: SparkSession, path: str, schema: str, day_of: str | None = None) -> None:
        self.spark, self.path, self.schema, self.day_of = spark, path, schema, day_of

    def ensure(self) -> None:
        """Create the table, empty, if it isn't there."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            self.write(nothing(self.spark, self.schema), -1)

    def write(self, df: DataFrame, epoch: int) -> None:
        rows = df.withColumn("day", F.to_date(self.day_of)) if self.day_of else df
        writer = rows.write.partitionBy("day") if self.day_of else rows.write
        writer.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self, before: int | None = None, since: Column | None = None) -> DataFrame:
        """All epochs, or those before one: what a replay of it must see; ``since``: only the folders of that day and later."""
        rows = self.spark.read.schema(f"{self.schema}, epoch long{', day date' if self.day_of else ''}").parquet(self.path)
        if since is not None and self.day_of:
            rows = rows.where(F.col("day") >= F.to_date(since))
        return (rows.where(F.col("epoch") < before) if before is not None else rows).drop("epoch", "day")

    def _files(self, *names: str):
        """The table's file system, and paths in its folder."""
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        paths = [jvm.org.apache.hadoop.fs.Path("/".join([self.path, *([n] if n else [])])) for n in names]
        return paths[0].getFileSystem(context._jsc.hadoopConfiguration()), *paths

    def has(self, epoch: int) -> bool:
        """Whether an epoch is written (an empty one has no rows to tell of it): one look, however many there are."""
        files, mark = self._files(f"epoch={epoch}/_SUCCESS")
        return files.exists(mark)

    def epoch(self, epoch: int) -> DataFrame:
        """What one epoch wrote."""
        return self.spark.read.schema(f"{self.schema}, epoch long{', day date' if self.day_of else ''}").parquet(self.path).where(F.col("epoch") == epoch).drop("epoch", "day")


class StateTable(EpochTable):
    """A table of state: every version whole, the two newest kept (a replay of the last epoch reads the one before)."""

    def versions(self) -> list[int]:
        """The epochs of the versions, oldest first; their folders are few, as ``write`` deletes the old ones."""
        files, root = self._files("")
        return sorted(int(x.getPath().getName()[6:]) for x in files.listStatus(root) if x.getPath().getName().startswith("epoch="))

    def write(self, df: DataFrame, epoch: int) -> None:
        super().write(df, epoch)
        for old in [e for e in self.versions() if e < epoch][:-1]:
            files, path = self._files(f"epoch={old}")
            files.delete(path, True)

    def version(self, before: int | None = None) -> DataFrame:
        last = max(e for e in self.versions() if (before is None or e < before) and self.has(e))
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch={last}")
