"""k-nearest-neighbour and similarity joins with scalar filters.

Vectors of one key meet block by block: one side is held in blocks of ``BLOCK`` vectors, the other goes past them in blocks of ``STREAM``, both
cut by a hash of their ids. Each pair of blocks is a group of its own, whose distances are matrix products of ``TILE`` rows. So a key of any number of
vectors is spread over as many tasks as it has pairs of blocks, a task holds one block and one tile, and a vector travels once for each block of the
other side. Of a join with itself only one of two mirrored pairs of blocks is made. What is decided of a pair is decided where its vectors are:
only pairs that belong to the result leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.operators.dedup import top_k

BLOCK, STREAM, TILE = 4096, 8192, 512
#: Pairs whose distances are computed anew, and rounded, at a time.
PAIRS = 1 << 16
#: Products of lengths under this give a distance of 1.
EPS = 1e-8
#: Dot products of a matrix that one candidate of a bucket costs: its vector travels to each of its buckets.
CANDIDATE = 32
#: Tables of signs at most; beyond that the exact join is taken.
MOST_TABLES = 512
#: What a tile's distances give: (row, column) places of the hits.
Chosen = Callable[[np.ndarray, pa.Array, pa.Array], tuple[np.ndarray, np.ndarray]]


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def narrow(df: DataFrame, vector_col: str) -> Column:
    """The vector as it travels: floats as floats, all else as doubles."""
    return F.col(vector_col) if dict(df.dtypes)[vector_col] == "array<float>" else as_double(F.col(vector_col))


class Block:
    """Vectors of one side of a group: ids, rows, lengths, and what came with each of them (``extra``, a list array)."""

    def __init__(self, parts: list[pa.RecordBatch], side: str) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        self.ids, self.extra = table[side].combine_chunks(), table["extra"].combine_chunks()
        self.rows = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
        self.size = np.linalg.norm(self.rows, axis=1)
        self.unit = np.divide(self.rows, self.size[:, None], out=np.zeros_like(self.rows), where=self.size[:, None] > 0)

    def codes(self) -> np.ndarray:
        """``extra`` as a matrix, where all rows have as many."""
        return self.extra.flatten().to_numpy(zero_copy_only=False).reshape(len(self.ids), -1)


Visit = Callable[[Block, Block, dict], pa.RecordBatch]


def rough(a: Block, b: Block) -> np.ndarray:
    """Distances of all pairs, neither clipped nor rounded; 1 where a vector is (nearly) zero."""
    far = a.unit @ b.unit.T
    np.subtract(1.0, far, out=far)
    if a.size.min() * b.size.min() < EPS:
        far[a.size[:, None] * b.size[None, :] < EPS] = 1.0
    return far


def distances(a: Block, b: Block, i: np.ndarray, j: np.ndarray, digits: int) -> np.ndarray:
    """1 - cosine similarity of the pairs at those places, clipped, rounded; 1 where a vector is (nearly) zero."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        size = a.size[x] * b.size[y]
        similarity = np.divide(np.einsum("ij,ij->i", a.rows[x], b.rows[y]), size, out=np.zeros(len(x)), where=size >= EPS)
        out[at : at + PAIRS] = np.round(1.0 - np.clip(similarity, -1.0, 1.0), digits)
    return out


def k_nearest(a: Block, b: Block, k: int, digits: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the ``k`` nearest columns of each row, of those allowed; equal rounded distances go by column."""
    far = rough(a, b)
    if allowed is not None:
        far[~allowed] = np.inf
    if far.shape[1] > k:
        kth = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        near = ~(far > kth + 10.0**-digits + 1e-9)  # whatever rounding may bring to the k-th; NaN is beyond all
    else:
        near = np.ones(far.shape, bool)
    i, j = np.nonzero(near if allowed is None else near & allowed)
    distance = distances(a, b, i, j, digits)
    order = np.lexsort((j, distance, i))
    i, j, distance = i[order], j[order], distance[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], distance[first]


def _hits(a: pa.Array, b: pa.Array, group: dict, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, b, group["first"].take(pa.array(np.zeros(len(a), int))), pa.array(distance)], names=["a", "b", "key", "distance"])


def over_blocks(left: DataFrame, right: DataFrame | None, on: list[str], id_col: str, vector_col: str, visit: Visit, schema: str, block: int = BLOCK, stream: int = STREAM, extra: str | None = None) -> DataFrame:
    """What ``visit`` makes of each tile of ``left`` and block of ``right`` with equal ``on`` (rows with a null id, vector or key go).

    ``extra``: a column of integer lists that travels with a vector. Without ``right``, ``left`` meets itself, and ``visit`` sees each two blocks once.
    ``visit`` gets the tile, the block with its ids ascending, and ``key`` (the values of ``on``; ``first``: the first of them as a column), ``i`` and ``j`` (the blocks).
    """
    one = right is None
    right, stream = (left, block) if one else (right, stream)
    keys = [f"k{n}" for n in range(len(on))]
    same = dict(left.dtypes)[vector_col] == dict(right.dtypes)[vector_col]

    def side(df: DataFrame) -> DataFrame:
        vector = narrow(df, vector_col) if same else as_double(F.col(vector_col))
        more = F.col(extra).cast("array<int>") if extra else F.lit(None).cast("array<int>")
        rows = df.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(id_col).alias("id"), vector.alias("vec"), more.alias("extra"))
        return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "id", "vec"]))

    a, b = side(left), side(right)
    counts = [x.groupBy(*keys).agg(F.ceil(F.count("*") / n).cast("int").alias(name)) for x, n, name in ((a, stream, "na"), (b, block, "nb"))]
    blocks = counts[1].withColumn("na", F.col("nb")) if one else counts[0].join(counts[1], keys)
    ids = {"a": dict(a.dtypes)["id"], "b": dict(b.dtypes)["id"]}

    def dealt(df: DataFrame, name: str, own: str, other: str, place: tuple[str, str], number: int, span: Column) -> DataFrame:
        rows = df.join(blocks, keys).withColumn(place[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(place[1], F.explode(span))
        named = [F.col("id").alias(n) if n == name else F.lit(None).cast(kind).alias(n) for n, kind in ids.items()]
        return rows.select(*keys, "i", "j", F.lit(number).alias("side"), *named, "vec", "extra")

    last_a, last_b = F.col("na") - 1, F.col("nb") - 1
    rows = dealt(b, "b", "nb", "na", ("j", "i"), 0, F.sequence(F.lit(0), F.col("j") if one else last_a))
    rows = rows.unionByName(dealt(a, "a", "na", "nb", ("i", "j"), 1, F.sequence(F.col("i") if one else F.lit(0), last_b)))
    groups = [*keys, "i", "j"]
    rows = rows.repartition(*groups).sortWithinPartitions(*groups, "side", "b", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            n = batch.num_rows
            changed = np.zeros(max(n - 1, 0), bool)
            for c in [*groups, "side"]:
                column = batch.column(c)
                changed |= pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
            for begin, end in pairwise([0, *(np.nonzero(changed)[0] + 1).tolist(), n] if n else []):
                mark = tuple(batch.column(c)[begin].as_py() for c in groups)
                if mark != now:
                    now, parts, held = mark, [], None
                piece = batch.slice(begin, end - begin)
                if batch.column("side")[begin].as_py() == 0:
                    parts.append(piece)
                    continue
                if parts:
                    held, parts = Block(parts, "b"), []
                if held is not None:
                    for at in range(0, piece.num_rows, TILE):
                        tile = Block([piece.slice(at, TILE)], "a")
                        yield visit(tile, held, {"key": mark[:-2], "i": mark[-2], "j": mark[-1], "first": piece.column(0).slice(0, 1)})

    return rows.mapInArrow(run, schema)


def block_join(left: DataFrame, right: DataFrame, on: str | None, id_col: str, vector_col: str, digits: int, choose: Chosen, block: int = BLOCK) -> DataFrame:
    """a, b, key, distance of the pairs that ``choose`` takes of each tile's rounded distances, of equal ``on`` (null vectors and keys go)."""
    kind_a, kind_b, key_kind = dict(left.dtypes)[id_col], dict(right.dtypes)[id_col], dict(left.dtypes)[on] if on else "int"
    if not on:
        on, left, right = "_all", left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))

    def visit(a: Block, b: Block, group: dict) -> pa.RecordBatch:
        distance = rough(a, b)
        np.round(1.0 - np.clip(1.0 - distance, -1.0, 1.0), digits, out=distance)
        i, j = choose(distance, a.ids, b.ids)
        return _hits(a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), group, distance[i, j])

    return over_blocks(left, right, [on], id_col, vector_col, visit, f"a {kind_a}, b {kind_b}, key {key_kind}, distance double", block, block)


def knn(queries: DataFrame, base: DataFrame, k: int, on: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] = (), digits: int = 6) -> DataFrame:
    """query_id, hit_id, distance, rank: the ``k`` nearest base rows of each query, among those of equal ``on``.

    Exact: each pair of blocks gives its k nearest of each query, of which the k nearest stay. Equal rounded distances go by id.
    """
    kind_a, kind_b, key_kind = dict(queries.dtypes)[id_col], dict(base.dtypes)[id_col], dict(queries.dtypes)[on] if on else "int"
    key = on or "_all"
    left, right = (queries, base) if on else (queries.withColumn(key, F.lit(0)), base.withColumn(key, F.lit(0)))

    def visit(a: Block, b: Block, group: dict) -> pa.RecordBatch:
        i, j, distance = k_nearest(a, b, k, digits)
        return _hits(a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), group, distance)

    hits = over_blocks(left, right, [key], id_col, vector_col, visit, f"a {kind_a}, b {kind_b}, key {key_kind}, distance double")
    hits = hits.select(F.col("a").alias("query_id"), F.col("b").alias("hit_id"), *([F.col("key").alias(f"query_{on}")] if on else []), "distance")
    hits = top_k(hits, ["query_id"], [F.col("distance").asc(), F.col("hit_id").asc()], k, "rank")
    if keep:
        hits = hits.join(base.select(F.col(id_col).alias("hit_id"), *[F.col(c).alias(f"hit_{c}") for c in keep]), "hit_id")
    return hits


def multi_collection_knn(queries: DataFrame, collections: dict[str, DataFrame], k: int, on: str | None = None, keep: list[str] = ()) -> DataFrame:
    """k // n hits of each of n collections (one if k isn't larger than n), together, tagged with the collection."""
    each = k // len(collections) if k > len(collections) else 1
    out = None
    for name, base in sorted(collections.items()):
        hits = knn(queries, base, each, on, keep=keep).withColumn("collection_name", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    return out


def _ordered(a: Block, b: Block, group: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of pairs of a join with itself: those that stay, and their lesser and greater ids; a block that meets itself has each pair twice."""
    x, y = a.ids.take(pa.array(i)), b.ids.take(pa.array(j))
    less = pc.less(x, y)
    if group["i"] == group["j"]:
        stay = np.nonzero(less.to_numpy(zero_copy_only=False))[0]
        return stay, x.take(pa.array(stay)), y.take(pa.array(stay))
    return np.arange(len(i)), pc.if_else(less, x, y), pc.if_else(less, y, x)


def _near_pairs(df: DataFrame, threshold: float | None, on: list[str], id_col: str, vector_col: str, extra: str | None = None, meets: Callable[[np.ndarray, np.ndarray, tuple], np.ndarray] | None = None) -> DataFrame:
    """a < b, key (the first of ``on``), distance: pairs strictly under the threshold (all, if there is none) whose ``extra`` codes ``meets`` lets pass."""
    kinds = dict(df.dtypes)

    def visit(a: Block, b: Block, group: dict) -> pa.RecordBatch:
        far = rough(a, b)
        i, j = np.nonzero(far < threshold + 2e-6 if threshold is not None else np.ones(far.shape, bool))
        if meets is not None:
            codes, others, kept = a.codes(), b.codes(), []
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                kept.append(meets(codes[x], others[y], group["key"]))
            kept = np.concatenate(kept) if kept else np.zeros(0, bool)
            i, j = i[kept], j[kept]
        distance = distances(a, b, i, j, 6)
        if threshold is not None:
            under = distance < threshold
            i, j, distance = i[under], j[under], distance[under]
        stay, x, y = _ordered(a, b, group, i, j)
        return _hits(x, y, group, distance[stay])

    schema = f"a {kinds[id_col]}, b {kinds[id_col]}, key {kinds[on[0]]}, distance double"
    return over_blocks(df, None, on, id_col, vector_col, visit, schema, extra=extra)


def similarity_pairs(df: DataFrame, threshold: float, on: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """a < b of equal ``on`` whose distance is strictly under the threshold. Exact."""
    return _near_pairs(df, threshold, [on], id_col, vector_col).select("a", "b", F.col("key").alias(on), "distance")


def same_side(threshold: float) -> float:
    """The probability that a random plane has two vectors of that cosine distance on one side; closer ones are likelier to be."""
    return 1.0 - math.acos(max(-1.0, min(1.0, 1.0 - threshold))) / math.pi


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """How many tables of that many bits find each pair within the threshold with at least the probability ``recall``."""
    found = same_side(threshold) ** bits
    return 1 if found >= recall else math.ceil(math.log(1.0 - recall) / math.log1p(-found))


def lsh_plan(threshold: float, recall: float, vectors: int) -> tuple[int, int] | None:
    """(tables, bits) of the least work for a key of so many vectors; none where comparing all of them is less.

    Work is counted in dot products a vector: one a bit and table, and ``CANDIDATE`` for each vector that is expected in its buckets by chance.
    """
    best = None
    for bits in range(1, 31):
        tables = tables_for(threshold, bits, recall)
        if tables <= MOST_TABLES:
            work = tables * (bits + CANDIDATE * vectors / 2**bits)
            best = min(best or (work, tables, bits), (work, tables, bits))
    return best[1:] if best and best[0] < vectors else None


def signed(df: DataFrame, on: str, dim: int, tables: int, bits: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """id, key, vec, codes: of each vector with an id and a key, one code a table, by the signs of seeded random projections."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
    rows = df.select(F.col(id_col).alias("id"), F.col(on).alias("key"), narrow(df, vector_col).alias("vec")).where("id IS NOT NULL AND key IS NOT NULL AND vec IS NOT NULL")
    places = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dim)
                signs = ((vectors @ planes.T > 0).reshape(batch.num_rows, tables, bits) @ places).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, signs.size + 1, tables, dtype=np.int32)), pa.array(signs.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=["id", "key", "vec", "codes"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, key {kinds['key']}, vec {kinds['vec']}, codes array<int>")


def sign_buckets(df: DataFrame, on: str, dim: int, tables: int, bits: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """id, key, bucket: of each vector with an id and a key, one bucket a table."""
    rows = signed(df, on, dim, tables, bits, id_col, vector_col, seed).select("id", "key", F.posexplode("codes").alias("table", "code"))
    return rows.select("id", "key", (F.shiftleft(F.col("table").cast("long"), bits) + F.col("code")).alias("bucket"))


def _first_shared(codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The first table that two vectors share a bucket of; -1 for none."""
    same = codes == others
    return np.where(same.any(axis=1), same.argmax(axis=1), -1)


def _sharing(df: DataFrame, threshold: float | None, on: str, dim: int, tables: int, bits: int, id_col: str, vector_col: str) -> DataFrame:
    """a < b, key, distance of the pairs that share a bucket of some table, each once, under the threshold if there is one.

    Vectors meet in their buckets, and a pair is given by the first table that it shares, so nothing has to be made distinct. Where the tables would
    compare more pairs than there are (few bits), the vectors of a key meet once and bring their codes along.
    """
    rows = signed(df, on, dim, tables, bits, id_col, vector_col)
    if tables >= 2**bits:
        return _near_pairs(rows, threshold, ["key"], "id", "vec", "codes", lambda x, y, _: _first_shared(x, y) >= 0)
    each = rows.select("id", "key", "vec", "codes", F.posexplode("codes").alias("table", "code"))
    return _near_pairs(each, threshold, ["key", "table", "code"], "id", "vec", "codes", lambda x, y, key: _first_shared(x, y) == key[1])


def lsh_candidates(df: DataFrame, on: str, dim: int, tables: int, bits: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """a < b of equal ``on`` that share a bucket of some table, each pair once."""
    return _sharing(df, None, on, dim, tables, bits, id_col, vector_col).select("a", "b", F.col("key").alias(on))


def lsh_tried(df: DataFrame, on: str, dim: int, tables: int, bits: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """tried: how many pairs ``lsh_candidates`` gives, counted where their vectors are."""
    small = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int32

    def visit(a: Block, b: Block, group: dict) -> pa.RecordBatch:
        shared = np.zeros((len(a.ids), len(b.ids)), bool)
        for mine, other in zip(a.codes().astype(small).T, b.codes().astype(small).T, strict=True):
            shared |= mine[:, None] == np.ascontiguousarray(other)[None, :]
        n = 2 * int(shared.sum())
        if group["i"] == group["j"]:  # each pair is there twice, and each vector with itself and with other rows of its id
            known = b.ids.unique()
            first = np.concatenate([[0], np.cumsum(np.bincount(pc.index_in(b.ids, known).to_numpy(zero_copy_only=False)))])
            own = [int(shared[row, first[at] : first[at + 1]].sum()) for row, at in enumerate(pc.index_in(a.ids, known).to_numpy(zero_copy_only=False))]
            n = n // 2 - sum(own)
        return pa.RecordBatch.from_arrays([pa.array([n])], names=["twice"])

    rows = over_blocks(signed(df, on, dim, tables, bits, id_col, vector_col), None, ["key"], "id", "vec", visit, "twice long", extra="codes")
    return rows.agg(F.coalesce((F.sum("twice") / 2).cast("long"), F.lit(0).cast("long")).alias("tried"))


def lsh_pairs(df: DataFrame, threshold: float, on: str, dim: int, recall: float = 0.95, bits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """As ``similarity_pairs``, for keys with many vectors: each pair is found with at least the probability ``recall``.

    Pairs that share a bucket are compared, in the task that the bucket lies in. The number of bits is that of the least work for the largest key,
    unless it is given, and the number of tables follows from it and the recall. Where the exact join is less work (small keys, wide
    thresholds), it is used.
    """
    if bits is None:
        largest = df.groupBy(on).count().agg(F.max("count")).first()[0] or 0
        if (plan := lsh_plan(threshold, recall, largest)) is None:
            return similarity_pairs(df, threshold, on, id_col, vector_col)
        tables, bits = plan
    else:
        tables = tables_for(threshold, bits, recall)
    return _sharing(df, threshold, on, dim, tables, bits, id_col, vector_col).select("a", "b", F.col("key").alias(on), "distance")
