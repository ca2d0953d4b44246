"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One pass over the whole texts gives each document its shingle count, a 128-bit digest of its shingle
   set and one key per band of its signature. Documents of equal sets form a class; only its least
   doc_id goes on, so exact copies cost a row each and never meet in a bucket.
2. Band buckets are counted with map-side partial sums. Buckets of up to ``small`` classes give all their pairs;
   a larger bucket ties each member to its least member, so pairs grow with rows, not with their square.
3. Every candidate pair is confirmed on the full sets, recomputed from the whole texts.
4. Links are grouped into components.
5. Large buckets whose members are still in several components are settled exactly: their members go
   through a prefix-filtered join (the rarest shingles of each set, so that what many documents share
   is never joined on unless it is nearly all they have), restricted to pairs of different components.

With 42 bands of 6 registers a pair at similarity 0.8 misses all bands with probability 3e-6.

Defined cases: a text without words has no set and is linked with nothing; rows repeating a doc_id are
one document, whose texts are linked; a null doc_id is never linked (component_id null, kept); an empty
table gives an empty result; a very long text is one block of its own, hashed as a whole; columns other than the two
named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.llm.common import discard, gives_back, maybe_among, stored
from voxtide.llm.components import components
from voxtide.llm.shingles import band_keys, blocks, column_blocks, shingle_sets, superminhash

BANDS, ROWS = 42, 6
#: Buckets of up to SMALL classes are compared in full; larger ones by their least member, then exactly.
SMALL = 16
#: Pairs that one copy of a text is compared in; classes of over 1/SLOTS of all rows are broadcast.
STAR, SLOTS = 256, 1024


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_digest, keys (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in column_blocks(batch.column(1)):
                sets, bounds = shingle_sets(part, words)
                size = np.diff(bounds)
                some = size > 0
                keys = band_keys(superminhash(sets, bounds, bands * rows)[some], bands)
                digest = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                offsets = np.concatenate([[0], np.cumsum(some * bands)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel(), pa.int64()))],
                    names=["doc_id", "n_shingles", "set_digest", "keys"],
                )

    return docs.mapInArrow(gives_back(run), "doc_id long, n_shingles long, set_digest binary, keys array<long>")


def _ratio(percent: int) -> str:
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"


def fetched(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``ids`` (doc_id), texts as bytes; what a filter of the ids clears is not shuffled."""
    rows = docs.where(maybe_among([F.col("doc_id")], ids)).join(ids, "doc_id", "left_semi")
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, star: int = STAR) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A text ``a`` of many pairs travels once for ``star`` of them: rows are dealt by (a, part), the text of ``a`` comes first, and the
    texts of its partners stream past its set. So no task meets a whole star, and a worker holds one set and one block of texts.
    """
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ids")
    texts = stored(fetched(docs, ids), "pair-texts")
    stars = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > star).select(F.col("a").alias("_a"), F.ceil(F.col("n") / star).alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("_parts")), F.lit(0)).cast("int")
    dealt = stored(pairs.join(stars, F.col("a") == F.col("_a"), "left").select("a", part.alias("part"), "b"), "dealt-pairs")
    centres = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    partners = dealt.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", "b", "text")
    rows = centres.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", "b")  # nulls first: the text of a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the sets of the texts of a: one, but for rows that repeat an id
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                good = []
                sets = [x for _, part in blocks(batch.column(3).to_pylist()) for x in _each(part, words)]
                for a, part, b, one in zip(*(batch.column(i).to_pylist() for i in range(3)), sets, strict=True):
                    if (a, part) != now:
                        now, held = (a, part), []
                    if b is None:
                        held.append(one)
                    good.append(b is not None and any(_alike(one, other, percent) for other in held))
                mask = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask)], names=["a", "b"])

    out = stored(rows.mapInArrow(gives_back(run), "a long, b long").distinct(), "links")
    discard(ids, texts, dealt)
    return out


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have the similarity asked for."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _each(texts: list[bytes], words: int) -> list[np.ndarray]:
    sets, bounds = shingle_sets(texts, words)
    return [sets[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _pairs(buckets: DataFrame, percent: int) -> DataFrame:
    named = buckets.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    return named.where(F.col("a") < F.col("b")).where(_ratio(percent)).select("a", "b")


def settle(members: DataFrame, roots: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Candidate pairs, over all members of large buckets that still span several components; exact.

    Two sets with the similarity asked for share one of the n - ceil(n * percent / 100) + 1 rarest shingles
    of either; and from the places where they share one, enough shingles must be left on either side.
    """
    labelled = members.join(roots, members["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    rest = stored(labelled.join(open_keys, "key", "left_semi").select("id", "root").distinct(), "open")
    if rest.isEmpty():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in column_blocks(batch.column(2)):
                sets, bounds = shingle_sets(part, words)
                size = np.diff(bounds)
                columns = [np.repeat(batch.column(k).slice(first, len(part)).to_numpy(zero_copy_only=False), size) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*columns, np.repeat(size, size), sets.view("i8"))], names=["id", "root", "n", "shingle"])

    texts = fetched(docs, rest.select(F.col("id").alias("doc_id")).distinct()).join(rest, F.col("doc_id") == F.col("id")).select("id", "root", "text")
    rows = stored(texts.mapInArrow(gives_back(run), "id long, root long, n long, shingle long"), "open-sets")
    often = rows.groupBy("shingle").agg(F.count("*").alias("f"))
    place = F.row_number().over(W.partitionBy("id", "root", "n").orderBy("f", "shingle")) - 1
    prefix = rows.join(often, "shingle").withColumn("at", place).where(F.expr(f"at < n - (n * {percent} + 99) DIV 100 + 1")).where("f > 1")
    tokens = stored(prefix.select("id", "root", "n", "at", "shingle"), "open-prefixes")
    x, y = tokens.alias("x"), tokens.alias("y")
    need = f"(100 + {percent}) * least(x.n - x.at, y.n - y.at) >= {percent} * (x.n + y.n)"
    near = F.expr(f"x.shingle = y.shingle AND x.id < y.id AND x.root != y.root AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {need}")
    out = stored(x.join(y, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "open-pairs")
    discard(rest, rows, tokens)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = stored(sketches(docs, words), "sketches")
    full = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    rows = full.join(classes, (full["set_digest"] == classes["set_digest"]) & (full["doc_id"] == classes["rep"])).select(
        F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")
    )
    rows = stored(rows, "band-rows")
    ends = [F.min("id").alias("lo"), F.min_by("n", "id").alias("n_lo"), F.max("id").alias("hi"), F.max_by("n", "id").alias("n_hi")]
    counted = stored(rows.groupBy("key").agg(F.count("*").alias("size"), *ends).where("lo < hi"), "buckets")
    twos = _pairs(counted.where("size = 2").select(F.struct(F.col("lo").alias("id"), F.col("n_lo").alias("n")).alias("x"), F.struct(F.col("hi").alias("id"), F.col("n_hi").alias("n")).alias("y")), percent)
    member, least = F.struct("id", "n"), F.struct(F.col("lo").alias("id"), F.col("n_lo").alias("n"))
    wide = stored(rows.join(counted.where("size > 2").select("key", "size", least.alias("lo")), "key").select("key", "size", "lo", member.alias("x")), "wide-buckets")
    few = wide.where(F.col("size") <= small).groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("m"))
    few = few.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x, y))))")).alias("p")).select("p.x", "p.y")
    many = wide.where(F.col("size") > small)
    pairs = stored(twos.unionByName(_pairs(few, percent)).unionByName(_pairs(many.select(F.col("lo").alias("x"), F.col("x").alias("y")), percent)).distinct(), "pairs")
    discard(rows, counted)
    links = verified(pairs, docs, words, percent)
    roots = components(links)
    more = settle(many.select("key", F.col("x.id").alias("id")), roots, docs, words, percent)
    if more is not None:
        fresh = stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = verified(fresh, docs, words, percent)
        first, roots = roots, components(found.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
        discard(more, fresh, found, first)
    discard(wide, pairs, links)
    return _labels(drawn, classes, roots)


def _labels(drawn: DataFrame, classes: DataFrame, roots: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Components of the classes' representatives, handed to every member by its class.

    Classes of over 1/``slots`` of the rows (so at most ``slots``) are broadcast; members of the others meet in small groups.
    """
    rooted = stored(classes.join(roots, classes["rep"] == roots["node"], "left").select("set_digest", "rows", F.coalesce("root", "rep").alias("class_root")), "class-roots")
    total = drawn.count()
    heavy = F.col("rows") * slots > total
    hot = F.broadcast(rooted.where(heavy).select("set_digest", F.col("class_root").alias("hot_root")))
    members = drawn.select("doc_id", "n_shingles", "set_digest").withColumn("set_digest", F.when(F.col("n_shingles") > 0, F.col("set_digest")))
    known = members.join(hot, "set_digest", "left")  # without words there is no class
    settled = known.where("hot_root IS NOT NULL OR n_shingles = 0").withColumnRenamed("hot_root", "class_root")
    rest = known.where("hot_root IS NULL AND n_shingles > 0").drop("hot_root").join(rooted.where(~heavy).select("set_digest", "class_root"), "set_digest", "left")
    out = settled.unionByName(rest)
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_root")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
