"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

language ID -> exact dedup -> MinHash near-dedup -> mixing to target weights -> best-fit packing
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import exact_dedup, langid, mixing, near_dedup, packing
from voxtide.llm.common import discard, maybe_among, stored
from voxtide.llm.queries import table, tokenizer_path

#: What the domains' present expected totals of tokens are to change by.
FACTORS = {"high": 1.0, "low": 1.0, "toxic": 0.15}
#: Documents whose likeliest domain is one of these stay at least once; the bound is part of the fit.
LEAST = {d: 1.0 for d, f in FACTORS.items() if f >= 1}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go. They are stored here: texts pass Python workers in batches of a bounded size
    only while a table is stored, and whoever reads a plan that ends in workers would hand them larger ones."""
    return stored(langid.keep_known(docs, langid.fit(docs, langid.learnable())), "known")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the one with the least doc_id stays."""
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    suspect = maybe_among([docs["doc_id"]], gone)  # the others stay where they are
    return docs.where(~suspect).unionAll(docs.where(suspect).join(gone, docs["doc_id"] == gone["_gone"], "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their fitted rate says, rounded without bias. The fit itself keeps documents of the
    domains that aren't to shrink; without labels, or without a miss of the targets, all stay once. Rows repeating a doc_id get the same
    number of copies; a null doc_id stays once."""
    rates = mixing.mix(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), FACTORS, of_present=True, least=LEAST).rates
    times = mixing.copies(F.col("rate"), F.col("doc_id"))
    other = rates.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), times.alias("_times")).where("_times != 1")
    other = stored(other.dropDuplicates(["_id"]), "mix")  # only what is not simply kept
    suspect = maybe_among([docs["doc_id"]], other.select("_id"))  # the others stay where they are
    joined = docs.where(suspect).join(other, docs["doc_id"] == other["_id"], "left")
    again = F.explode(F.array_repeat(F.lit(0), F.coalesce("_times", F.lit(1)).cast("int")))
    return docs.where(~suspect).unionAll(joined.withColumn("_copy", again).select(*[docs[c] for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), together=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenizing, centroids and sketches aren't SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        fresh = stage(spark, docs, sf_dir)
        fresh = fresh if hasattr(fresh, "_stored_at") else stored(fresh, f"stage-{i}")
        discard(docs)  # what the stage before wrote
        docs = fresh
    return docs
