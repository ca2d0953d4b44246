"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or the context; only a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxtide-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_scope: ContextVar[list[DataFrame] | None] = ContextVar("tables of the innermost scope", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are ``written`` within it are deleted at its end, whether it ends well or not."""
    mine: list[DataFrame] = []
    before = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(before)
        dropped(*mine)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table of its own: its lineage is cut, a lost executor costs a read, and later joins know its size."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (tables := _scope.get()) is not None:
        tables.append(out)
    return out


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, without the Python workers that an empty list starts."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_written_at", None)) is not None:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
