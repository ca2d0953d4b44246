"""Connected components of an undirected graph by star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.sources.shared import dropped, written


def star_contraction(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = written, drop: Callable[[DataFrame], None] = dropped, rounds: int = 60) -> DataFrame:
    """(u, v) of every node u of ``edges`` (u > v, distinct, written by ``keep``) that isn't the least node v of its component.

    Alternates large-star (every larger neighbour of a node is tied to its least neighbour) and small-star (all smaller
    neighbours are); the edges end as stars around the least nodes. A round shuffles the edges a few times; a node of very many
    neighbours is met by partial aggregates and by joins that Spark can split. Only counts reach the driver.
    """
    now, mark = edges, (0, None, None, None)  # without edges, one round tells
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop(before)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            return now
        mark = found
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """``nodes`` with ``component``: the least node reachable."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    roots = star_contraction(written(pairs, "edges"))
    out = nodes.join(roots.select(F.col("u").alias("_u"), F.col("v").alias("_root")), nodes[node] == F.col("_u"), "left")
    return out.withColumn("component", F.coalesce("_root", node)).drop("_u", "_root")
