"""A vector collection with an inverted-file index: lists around k-means centroids, one folder a list.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors, drawn by a hash of the id); every vector is then assigned to its nearest
one, and written to that list's folder with a radius of each list and key: the distance of its farthest member. Distances between unit
vectors obey the triangle inequality, so no member of a list is nearer to a query than ``|query - centroid| - radius``. A search probes
the nearest lists; those whose bound lies beyond the k-th hit hold nothing nearer. Probing alone tells of each query whether its answer is
proven; the exact search goes on to the lists that are not ruled out. Folders of lists that no query needs are never read.

Scale: assigning is one narrow pass; what goes to all tasks is the centroids (``LISTS`` at most, 8 bytes a number: 8 MB at 1024
dimensions). The lists of a key stand on shelves of about ``SHELF`` vectors, lists that are near to each other together. A query goes once to each shelf
that holds a list it needs, with the numbers of these lists, and k hits of a shelf come back: what is shuffled follows the shelves, not the lists.
Queries and vectors of a shelf meet in blocks (``vector_search.over_blocks``), so a list or key with a third of all vectors is many tasks.

Defined cases: null vectors, ids and keys are left out; a zero vector is at distance 1 from all, lies in a list of its own, and is looked at
by every exact search; a query that is zero is at distance 1 from all and searches every list; ties go by id; an empty collection has no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.operators.dedup import top_k
from voxtide.operators.vector_search import BLOCK, Block, _hits, k_nearest, narrow, over_blocks
from voxtide.sources.shared import written

SAMPLE, LISTS, ROUNDS = 20_000, 1024, 12
#: So that a shelf and the rest of a list still are one block.
SHELF = BLOCK * 3 // 4
#: Rounded distances may be off by this much.
SLACK = 2e-6
#: Vectors that are held against all centroids at a time.
SLICE = 1024


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows, without Python numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size >= 1e-8)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors from a start at evenly spaced rows."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
        total, n = np.zeros_like(centre), np.bincount(own, minlength=k)
        np.add.at(total, own, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


@dataclass
class VectorIndex:
    """``lists``: list, id, key, vec and further columns, a folder a list; ``radii``: of each key, the radius of each list (null: empty), and its shelf."""

    lists: DataFrame
    radii: DataFrame
    centroids: np.ndarray
    key_kind: str


def _order(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors: the lists by their distance, nearest first, the list of zero vectors last; the distances; which vectors are zero."""
    x = _unit(x)
    zero = ~x.any(axis=1)
    far = (centroids * centroids).sum(axis=1)[None] - 2 * x @ centroids.T + (x * x).sum(axis=1)[:, None]
    d = np.sqrt(np.maximum(far, 0.0))
    d[zero] = 0.0  # nothing rules a list out
    order = np.argsort(d, axis=1, kind="stable")
    lists = np.concatenate([order, np.full((len(x), 1), len(centroids))], axis=1).astype(np.int32)
    return lists, np.concatenate([np.take_along_axis(d, order, axis=1), np.zeros((len(x), 1))], axis=1), zero


def _near(centroids: np.ndarray):
    """Over (..., vec): the lists by their distance, nearest first; the list of zero vectors last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lists, d, zero = _order(matrix(batch.column("vec")), centroids)
                near = pa.StructArray.from_arrays([pa.array(lists.ravel()), pa.array(d.ravel())], ["list", "d"])
                near = pa.ListArray.from_arrays(pa.array(np.arange(len(zero) + 1, dtype=np.int32) * lists.shape[1]), near)
                yield pa.RecordBatch.from_arrays([*batch.columns, near, pa.array(zero)], names=[*batch.schema.names, "near", "zero"])

    return run


def _nearest(centroids: np.ndarray):
    """Over (..., vec): ``far``, the distance of the nearest list (2 for a zero vector), and ``list``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lists, d, zero = _order(matrix(batch.column("vec")), centroids)
                own = [pa.array(np.where(zero, 2.0, d[:, 0])), pa.array(np.where(zero, len(centroids), lists[:, 0]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "far", "list"])

    return run


def _asks(centroids: np.ndarray, probes: int, rest: bool):
    """Over (id, key, vec, radii, shelves, bound): a row for each shelf that a vector is looked for on, with the lists there (``todo``).

    They are the ``probes`` nearest that have members, or, of the ``rest``, those that may hold something within ``bound``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lists, d, _ = _order(matrix(batch.column("vec")), centroids)
                radii = np.take_along_axis(matrix(batch.column("radii")), lists, axis=1)
                live = ~np.isnan(radii)
                place = np.cumsum(live, axis=1)
                taken = live & (place <= probes)
                if rest:
                    bound = batch.column("bound").to_numpy(zero_copy_only=False)
                    taken = live & (place > probes) & (d - radii <= bound[:, None])
                row, column = np.nonzero(taken)
                asked = lists[row, column]
                shelf = matrix(batch.column("shelves"))[row, asked].astype(np.int32)
                order = np.lexsort((asked, shelf, row))
                row, asked, shelf = row[order], asked[order], shelf[order]
                first = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])]))[0] if len(row) else np.zeros(0, int)
                todo = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(asked))
                rows = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("id", "key", "vec")], pa.array(shelf[first]), todo], names=["id", "key", "vec", "shelf", "todo"])

    return run


def _distinct_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).flatten().unique()], names=["list"])


def _rows(df: DataFrame, id_col: str, key_col: str, vector_col: str, keep: list[str] = ()) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(key_col).alias("key"), narrow(df, vector_col).alias("vec"), *keep)
    return rows.where("id IS NOT NULL AND key IS NOT NULL AND vec IS NOT NULL")


def _placed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(_near(centroids), f"{kinds}, near array<struct<list: int, d: double>>, zero boolean")


def build(base: DataFrame, folder: str, id_col: str = "vec_id", key_col: str = "gm_code", vector_col: str = "embedding", keep: list[str] = (), lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index every row of ``base`` in ``folder``. ``lists``: about the square root of the number of rows, and ``LISTS`` at most, if not given."""
    spark, rows = base.sparkSession, _rows(base, id_col, key_col, vector_col, keep)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().combine_chunks()
    x = _unit(matrix(drawn["vec"].combine_chunks())) if len(drawn) else np.zeros((0, 1))
    x = x[x.any(axis=1)]
    n = min(lists or int(np.ceil(np.sqrt(rows.count()))), LISTS, len(x))
    centroids = kmeans(x, n) if n else np.zeros((0, x.shape[1]))
    if n:  # lists that are near to each other get numbers that are
        coarse = kmeans(centroids, int(np.ceil(np.sqrt(n))))
        centroids = centroids[((centroids[:, None] - coarse[None]) ** 2).sum(axis=2).argmin(axis=1).argsort(kind="stable")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    assigned = rows.mapInArrow(_nearest(centroids), f"{kinds}, far double, list int")
    assigned.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    schema = ", ".join(f"`{c}` {t}" for c, t in assigned.dtypes)
    whole = spark.read.schema(schema).parquet(f"{folder}/lists")
    each = whole.groupBy("key", "list").agg(F.max("far").alias("r"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("list").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("shelf", F.floor(before / SHELF).cast("int"))
    maps = [F.map_from_entries(F.collect_list(F.struct("list", c))).alias(c) for c in ("r", "shelf")]
    numbers = F.sequence(F.lit(0), F.lit(n))
    radii, shelves = F.transform(numbers, lambda i: F.col("r")[i]), F.transform(numbers, lambda i: F.col("shelf")[i])
    each.groupBy("key").agg(*maps).select("key", radii.alias("radii"), shelves.alias("shelves")).write.mode("overwrite").parquet(f"{folder}/radii")
    spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    return opened(spark, folder, dict(assigned.dtypes))


def opened(spark: SparkSession, folder: str, kinds: dict[str, str] | None = None) -> VectorIndex:
    """An index that was built."""
    centroids = spark.read.parquet(f"{folder}/centroids").orderBy("list").toArrow().combine_chunks()
    lists = spark.read.parquet(f"{folder}/lists") if kinds is None else spark.read.schema(", ".join(f"`{c}` {t}" for c, t in kinds.items())).parquet(f"{folder}/lists")
    x = matrix(centroids["centroid"].combine_chunks()) if len(centroids) else np.zeros((0, 1))
    return VectorIndex(lists, spark.read.parquet(f"{folder}/radii"), x, dict(lists.dtypes)["key"])


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int = 4, exact: bool = True, id_col: str = "vec_id", key_col: str = "gm_code", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, hit_id, distance, rank, proven: the ``k`` nearest vectors of equal key. ``proven``: no list that wasn't searched can hold a nearer one (always, if ``exact``)."""
    asking = _rows(queries, id_col, key_col, vector_col)
    kinds = dict(asking.dtypes)
    schema = f"id {kinds['id']}, key {kinds['key']}, vec {kinds['vec']}, shelf int, todo array<int>"

    def asks(rows: DataFrame, rest: bool) -> DataFrame:
        return rows.join(index.radii, "key").select("id", "key", "vec", "radii", "shelves", "bound").mapInArrow(_asks(index.centroids, probes, rest), schema)

    def visit(a: Block, b: Block, group: dict) -> pa.RecordBatch:
        own = b.codes()[:, 0]
        wanted = np.zeros((len(a.ids), len(index_lists)), bool)
        wanted[np.repeat(np.arange(len(a.ids)), np.diff(a.extra.offsets.to_numpy())), a.extra.flatten().to_numpy()] = True
        i, j, distance = k_nearest(a, b, k, digits, wanted[:, own])
        return _hits(a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), group, distance)

    def hits(asked: DataFrame) -> DataFrame:
        """The k nearest of each shelf, in the lists of ``todo``; only their folders are read."""
        needed = [r["list"] for r in asked.select("todo").mapInArrow(_distinct_lists, "list int").distinct().collect()]  # LISTS at most
        shelved = index.lists.where(F.col("list").isin(needed)).join(index.radii.select("key", "shelves"), "key")
        base = shelved.select("id", "key", "vec", F.col("shelves")[F.col("list")].alias("shelf"), F.array("list").alias("todo"))
        schema = f"a {kinds['id']}, b {dict(base.dtypes)['id']}, key {kinds['key']}, distance double"
        found = over_blocks(asked, base, ["key", "shelf"], "id", "vec", visit, schema, extra="todo")
        return found.select(F.col("a").alias("query_id"), F.col("b").alias("hit_id"), "distance")

    def best(found: DataFrame) -> DataFrame:
        return top_k(found, ["query_id"], [F.col("distance").asc(), F.col("hit_id").asc()], k, "rank")

    index_lists = range(len(index.centroids) + 1)
    found = written(best(hits(written(asks(asking.withColumn("bound", F.lit(0.0)), False), "asked"))), "probed")
    last = found.groupBy("query_id").agg(F.max("distance").alias("worst"), F.count("*").alias("n"))
    bound = F.when(F.col("n") == k, F.sqrt(2 * (F.col("worst") + SLACK)))  # of unit vectors at that distance
    more = asking.join(last, asking["id"] == last["query_id"], "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))
    rest = asks(more, True)
    if not exact:
        open_ids = rest.select(F.col("id").alias("query_id"), F.lit(False).alias("proven")).distinct()
        return found.join(open_ids, "query_id", "left").withColumn("proven", F.coalesce("proven", F.lit(True)))
    return best(found.drop("rank").unionByName(hits(written(rest, "open")))).withColumn("proven", F.lit(True))


def probes_for(index: VectorIndex, k: int, recall: float = 0.95, sample: int = 400) -> int:
    """The fewest probes that find ``recall`` of the ``k`` nearest others of a sample of the index's own vectors (``sample`` at most, by a hash of their ids)."""
    drawn = written(index.lists.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "key", "vec"), "sample")
    hits = search(drawn, index, k + 1, id_col="id", key_col="key", vector_col="vec").where("query_id != hit_id")
    live = F.filter("near", lambda x: F.col("radii")[x["list"]].isNotNull())
    near = _placed(drawn, index.centroids).join(index.radii, "key").select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), F.transform(live, lambda x: x["list"]).alias("order"))
    homes = index.lists.select(F.col("id").alias("hit_id"), F.col("key").alias("query_key"), "list")
    places = hits.join(near, "query_id").join(homes, ["hit_id", "query_key"]).groupBy(F.array_position("order", F.col("list")).alias("place")).count().orderBy("place").collect()
    wanted, seen = recall * sum(r["count"] for r in places), 0
    for r in places:  # LISTS at most
        seen += r["count"]
        if seen >= wanted:
            return int(r["place"])
    return 1
