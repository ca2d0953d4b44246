"""Vectors of texts that were embedded before: a table in hash buckets, read only in the buckets that a batch's texts fall in.

Rows are (digest, embedding) in a folder a bucket; a batch appends what it had to ask. Texts themselves aren't kept. A replayed
batch may append a text again; the least vector of a digest counts, so an answer stays what it was for readers of one state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "digest binary, embedding array<double>, bucket int"


class EmbeddingCache:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _keyed(self, text: Column) -> list[Column]:
        return [F.unhex(F.sha2(text, 256)).alias("digest"), F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int").alias("bucket")]

    def _there(self) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def found(self, texts: DataFrame, text: str) -> DataFrame:
        """The distinct texts that are known, and ``_vector``."""
        if not self._there():
            return texts.select(text, F.lit(None).cast("array<double>").alias("_vector")).limit(0)
        keyed = texts.select(text, *self._keyed(F.col(text)))
        needed = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]
        known = self.spark.read.schema(SCHEMA).parquet(self.folder).where(F.col("bucket").isin(needed)).join(keyed.select("digest").distinct(), "digest", "left_semi")
        known = known.groupBy("digest").agg(F.min("embedding").alias("_vector"))
        return keyed.join(known, "digest").select(text, "_vector")

    def add(self, vectors: DataFrame, text: str, column: str) -> None:
        rows = vectors.where(F.col(column).isNotNull()).select(*self._keyed(F.col(text)), F.col(column).alias("embedding"))
        rows.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(self.folder)
