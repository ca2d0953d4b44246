"""Connected components of an edge table by union-find within tasks and star contraction between them.

Nothing but counts reaches the driver. A round shuffles the edges a few times; a node with very many
neighbours is met by partial aggregates and by joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import discard, gives_back, stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one Arrow batch at a time: each node points to its least known root."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            low, high = (a, b) if a < b else (b, a)
            parent[high] = low
            parent.setdefault(low, low)
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (two long columns) that isn't its component's least node.

    Alternates large-star (every larger neighbour of a node is tied to its least neighbour) and
    small-star (all smaller neighbours are); the edges end as stars around the least nodes.
    """
    a, b = edges.columns[:2]
    now = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).mapInArrow(gives_back(_forest), "u long, v long")
    now = stored(now.distinct(), "edges")  # u > v throughout
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        found = now.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._stored_at = now._stored_at
            return out
        mark = found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
