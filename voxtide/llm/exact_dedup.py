"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. Every text becomes the SHA-256 of its white-space-normalised form; only (doc_id, digest)
   travels from here on, in a written table.
2. Misra-Gries (``DataFrame.freqItems``, a mergeable counter summary of ``slots`` entries) names
   every digest that may hold more than one row in ``slots``. At most ``slots`` candidates exist.
3. Candidates are verified by an exact count; the winners (again at most ``slots``) are broadcast,
   and their rows are decided on the map side: a copy group of a third of all rows never shuffles.
4. All other digests are counted by an ordinary shuffle with partial sums; only those with more than one row are joined
   back, so that no task gathers a group.
5. ``keep_first`` tests the texts' ids against a Bloom filter of the rows that go; only what it can't clear is joined, so that
   most texts are never shuffled.

Defined cases: a null text equals the empty text; an empty table gives an empty result; a null
doc_id only stays if every row of its group has one; rows repeating a doc_id and a text are one
document, so they carry the same decision (``group_size`` counts all rows), and ``keep_first`` keeps one of them. A very
long text is digested as a whole like any other. Other columns of the input are not touched, whatever their names, but
``keep_first`` can't take columns named ``_digest`` or ``_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtide.llm.common import maybe_among, stored, unhex_sha256

#: Entries of the Misra-Gries summary: a digest with more than 1/SLOTS of all rows is never shuffled.
SLOTS = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; only runs that would change are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), unhex_sha256(normalised(F.col(text_col))).alias("digest"))


def heavy_digests(prints: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Verified heavy hitters: (digest, keep_id, group_size) of every digest with over 1/slots of the rows."""
    key = F.xxhash64("digest")
    found = prints.select(key.alias("h")).freqItems(["h"], 1.0 / slots).first()
    rows = prints.count()
    exact = (
        prints.where(key.isin(list(found[0] or [])))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return exact.where((F.col("group_size") > 1) & (F.col("group_size") * slots > rows))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept."""
    prints = stored(digests(docs, id_col, text_col), "digests")
    winners = F.broadcast(heavy_digests(prints, slots))
    hot = prints.join(winners, "digest").select("doc_id", "digest", "keep_id", "group_size")
    rest = prints.join(winners.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups.where("group_size > 1"), "groups")
    cold = rest.join(groups.withColumnRenamed("keep_id", "_keep"), "digest", "left")
    cold = cold.select("doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    return hot.unionByName(cold).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """The input rows that stay, with the input's columns: one of each text. Rows that repeat a doc_id and a text are one too: the first
    by the other columns stays."""
    decided = stored(decide(docs, id_col, text_col, slots).select("doc_id", "digest", "kept"), "decided")
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest"))
    gone = stored(gone, "copies")
    again = decided.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    suspect = maybe_among([docs[id_col]], gone.select("_gone_id").unionAll(again).distinct())
    digest = unhex_sha256(normalised(docs[text_col]))
    kept = docs.where(suspect).withColumn("_digest", digest)
    kept = kept.join(gone, kept[id_col].eqNullSafe(F.col("_gone_id")) & (F.col("_digest") == F.col("_gone_digest")), "left_anti")
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col) and isinstance(f.dataType, T.AtomicType)]
    first = F.row_number().over(W.partitionBy(id_col, "_digest").orderBy(*others, text_col))
    kept = kept.withColumn("_first", first).where("_first = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~suspect).unionAll(kept)
