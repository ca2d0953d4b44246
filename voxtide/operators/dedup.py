"""Distinct rows by key, with a fixed order, and top-k rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key. Spark limits each task to k rows of a key before the shuffle."""
    out = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """A row of each key, the first by ``order``; rows without a key are kept, none of them equals another."""
    keyed = top_k(df.where(F.col(key).isNotNull()), [key], [F.col(order).asc()], 1)
    return keyed.unionByName(df.where(F.col(key).isNull()))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """A row of each key, the last by ``order``; rows without a key go."""
    return top_k(df.where(F.col(key).isNotNull()), [key], [F.col(order).desc()], 1)


def best_per_key(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of the highest score of each key; equal scores go by ``tie``; a null key goes."""
    kept = df
    for key in keys:
        kept = kept.where(F.col(key).isNotNull())
    return top_k(kept, keys, [F.col(score).desc(), F.col(tie).asc()], 1)
