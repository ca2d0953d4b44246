"""Scans: incremental, initial, time range, point lookups; keyword, stopword and vector-collection sources.

Filters are plain predicates, so that they and the column list reach the Parquet scan; a limit with an order is a
top-n in each task and not a sort of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental_scan(df: DataFrame, cursor: int, limit: int, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) > cursor).orderBy(id_col).limit(limit)


def initial_scan(df: DataFrame, start: Column, limit: int, time_col: str = "gmt_create", id_col: str = "id") -> DataFrame:
    return df.where(F.col(time_col) >= start).orderBy(time_col, id_col).limit(limit)


def time_range_scan(df: DataFrame, start: Column, end: Column, time_col: str = "gmt_create") -> DataFrame:
    return df.where((F.col(time_col) >= start) & (F.col(time_col) < end))


def anchor_id(df: DataFrame, start: Column, time_col: str = "gmt_create", id_col: str = "id") -> DataFrame:
    """The id of the first row at or after ``start``; 0 if there is none."""
    return df.where(F.col(time_col) >= start).agg(F.coalesce(F.min_by(id_col, F.struct(time_col, id_col)), F.lit(0)).cast("long").alias("anchor_id"))


def next_cursor(scanned: DataFrame, cursor: int, id_col: str = "id") -> DataFrame:
    """The largest scanned id, whether its row was kept or not; else the old cursor."""
    return scanned.agg(F.coalesce(F.max(id_col), F.lit(cursor)).cast("long").alias("cursor"))


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a semi-join, broadcast by Spark if the list is small."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def timed_voices(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(voices with an id and a time, quarantined rows without)."""
    good = F.col("voice_id").isNotNull() & F.col("gmt_create").isNotNull()
    return df.where(good), df.where(~good)


def quarantine_reason() -> Column:
    """Why ``timed_voices`` keeps a row back."""
    return F.concat_ws(", ", F.when(F.col("voice_id").isNull(), "no voice_id"), F.when(F.col("gmt_create").isNull(), "no gmt_create"))


def nested_voices(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(voices with a struct of source fields and dates as text, quarantined rows without an id or a time)."""
    good, bad = timed_voices(df)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    meta = F.struct(text("gmt_create"), text("add_date"), *[F.col(c) for c in ("voice_channel", "uid", "voice_detail_link") if c in df.columns])
    return good.select("id", "voice_id", F.col("title").alias("voice_title"), meta.alias("source_metadata")), bad


def stopwords(spark: SparkSession, path: str) -> Column:
    """The words of a text file, one a line, as an array literal (a short, hand-kept list)."""
    rows = spark.read.text(path).select(F.upper(F.trim("value")).alias("w")).where("w != ''").distinct().collect()
    return F.array(*[F.lit(r["w"]) for r in sorted(rows, key=lambda r: r["w"])]).cast("array<string>")


def keyword_dictionary(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """gm_code, goc_product_line, entity, action of a CSV file or a Parquet table (``kind``, or by the name); an empty cell is null."""
    if kind == "csv" or kind is None and path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema="gm_code string, goc_product_line string, entity string, action string")
    return spark.read.parquet(path).select("gm_code", "goc_product_line", "entity", "action")


def vector_filter(equal: dict[str, object] | None = None, at_least: dict[str, object] | None = None, among: dict[str, list] | None = None) -> Column:
    """The scalar filter language of a vector collection: a conjunction of equals, at-least and membership tests."""
    test = F.lit(True)
    for name, value in (equal or {}).items():
        test = test & (F.col(name) == value)
    for name, value in (at_least or {}).items():
        test = test & (F.col(name) >= value)
    for name, values in (among or {}).items():
        test = test & F.col(name).isin(*values)
    return test
