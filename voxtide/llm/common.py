"""Helpers shared by the corpus operators: shared storage, key filters, salted ranks, workers that give memory back."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one salt bucket of a ranked key holds on average.
ROWS_PER_BUCKET = 2048


#: Rows and bytes of an Arrow batch while an intermediate table is written: what a worker and its executor hold of the input at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: 64-bit words of a key filter: 16 bits a key, and at most 4 MB.
FILTER_WORDS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own; on a cluster that would lose rows, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not a re-computation), and gives later
    joins the true size of the table, so that a broadcast is chosen by a checked size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, plans that run Python workers hand them batches of at most ``BATCH``."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) is not None:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def gives_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over Arrow batches; when its task ends, memory that it has freed goes back to the system.

    Workers outlive their tasks: what an allocator keeps of one stage would be missing in the next.
    """

    @functools.wraps(run)
    def lean(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return lean


def _bits(values: list[Column], size: int) -> tuple[Column, Column]:
    """A key's word of a filter of ``size`` words, and its two bits there."""
    h = F.xxhash64(*values)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, n).bitwiseAND(63).cast("int")) for n in (40, 48)]
    return F.pmod(h, F.lit(size)).cast("int"), bits[0].bitwiseOR(bits[1])


def filter_words(keys: DataFrame, words: int = FILTER_WORDS) -> np.ndarray:
    """A Bloom filter of the rows of ``keys``: 64-bit words, two bits a key in one word; 16 bits a key and at most ``words`` words."""
    size, n = 64, keys.count()
    while size < words and size * 4 < n:
        size *= 2
    at, mask = _bits([F.col(c) for c in keys.columns], size)
    found = keys.select(at.alias("at"), mask.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size, np.int64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table


def maybe_among(columns: list[Column], keys: DataFrame, words: int = FILTER_WORDS) -> Column:
    """False only where the values of ``columns`` are none of the rows of ``keys``: a Bloom filter of two bits in one word.

    It has 16 bits a key and at most ``words`` words, whatever the number of keys; with more keys it lets more rows through,
    which costs a join its advantage and never its rows. The driver holds the words alone.
    """
    table = filter_words(keys, words)
    one = keys.sparkSession.createDataFrame(pa.table({"words": pa.array([table], pa.list_(pa.int64()))}), "words array<long>")
    at, mask = _bits(columns, len(table))
    return F.get(one.scalar(), at).bitwiseAND(mask) == mask


def local_table(spark: SparkSession, schema: str, **columns) -> DataFrame:
    """A small driver-side table of long columns as a relation of known size."""
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}), schema)


def salted_rank(df: DataFrame, key: str, order: list[str], out: str, sizes: DataFrame | None = None) -> DataFrame:
    """``out``: a gapless rank from 0 of each row within ``key``, without gathering a key in one task.

    Rows of a key are dealt over as many hash buckets as its size asks for, ranked in their
    bucket, and lifted by the prefix sum of the smaller buckets. A pure function of the data, so a
    recomputed task gives the same ranks. ``sizes`` (key, _rows) may be given if known.
    """
    sizes = sizes if sizes is not None else df.groupBy(key).agg(F.count("*").alias("_rows"))
    salts = sizes.select(key, F.ceil(F.col("_rows") / ROWS_PER_BUCKET).cast("long").alias("_salts"))
    dealt = df.join(salts, key).withColumn("_salt", F.expr(f"pmod(xxhash64({', '.join(order)}), _salts)"))
    counts = dealt.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    lifts = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"))
    here = F.row_number().over(W.partitionBy(key, "_salt").orderBy(*order)) - 1
    ranked = dealt.withColumn("_here", here).join(lifts, [key, "_salt"])
    return ranked.withColumn(out, F.col("_lift") + F.col("_here")).drop("_salts", "_salt", "_here", "_lift")


def unhex_sha256(text: Column) -> Column:
    """32 raw bytes of the SHA-256 of a string's UTF-8."""
    return F.unhex(F.sha2(text, 256))
