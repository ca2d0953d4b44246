"""Clusters of a batch: primary codes, context summaries, splitting by a model's answer, what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions import scoring, text


def primary_codes(routed: DataFrame, unknown: str = "unknown") -> DataFrame:
    """gm_code, voices, goc_product_line of the voices' first routes; the line is that of the last voice whose line is known."""
    first = F.try_element_at("routes", F.lit(1))
    rows = routed.select("id", F.coalesce(first["gm_code"], F.lit(unknown)).alias("gm_code"), first["goc_product_line"].alias("line"))
    known = F.when(F.coalesce("line", F.lit(unknown)) != unknown, F.struct("id", "line"))
    return rows.groupBy("gm_code").agg(F.count("*").alias("voices"), F.coalesce(F.max(known)["line"], F.lit(unknown)).alias("goc_product_line"))


def context_summaries(voices: DataFrame, keys: list[str], summary: str, most: int = 5) -> DataFrame:
    """The first ``most`` distinct non-empty summaries of each cluster, in order."""
    kept = voices.where(F.coalesce(summary, F.lit("")) != "").select(*keys, summary).distinct()
    ranked = kept.groupBy(*keys).agg(F.array_sort(F.collect_set(summary)).alias("s"))
    return ranked.select(*keys, F.slice("s", 1, most).alias("context_summaries"))


def split(members: DataFrame, answers: DataFrame) -> DataFrame:
    """``members`` (cluster_id, pos from 0, id, title) with success, title and sub_cluster_id by the model's answer (cluster_id, answer).

    An answer that doesn't cover each member falls back to the shortest cleaned title; where summaries
    overlap, the last one has the member. Only answered clusters are spelled out member by member.
    """
    clean = text.fallback_title(F.col("title"))
    whole = members.groupBy("cluster_id").agg(F.count("*").cast("int").alias("n"), F.min_by(clean, F.struct(F.length(clean), "pos")).alias("fallback"))
    named = whole.join(answers, "cluster_id", "left")
    judged = named.where("answer IS NOT NULL").withColumn("v", scoring.valid_summaries(F.col("answer"), F.col("n"), F.col("fallback"))).where("v.success = 1")
    each = judged.select("cluster_id", F.posexplode("v.summaries").alias("part", "s"))
    owned = each.select("cluster_id", "part", F.col("s.text").alias("_text"), F.explode("s.original_indices").alias("pos"))
    last = owned.groupBy("cluster_id", "pos").agg(F.max("part").alias("part"), F.max_by("_text", "part").alias("_text"))
    joined = members.join(whole.select("cluster_id", "fallback"), "cluster_id").join(last, ["cluster_id", "pos"], "left")
    part, good = F.coalesce("part", F.lit(0)), F.col("_text").isNotNull()
    title = F.coalesce("_text", "fallback")
    return joined.select("cluster_id", "id", good.cast("int").alias("success"), title.alias("batch_cluster_title"), text.stable_id("sub", F.col("cluster_id"), part).alias("sub_cluster_id"))


def unclustered(voices: DataFrame, clustered: DataFrame, key: str = "id", marker: str = "UNCLUSTERED") -> DataFrame:
    """Voices that are in no cluster, marked so."""
    return voices.join(clustered.select(key), key, "left_anti").withColumn("batch_cluster_id", F.lit(marker)).withColumn("batch_cluster_success", F.lit(False))


def cache_misses(titles: DataFrame, cache: DataFrame, title: str) -> DataFrame:
    """Distinct titles that aren't in the cache."""
    return titles.where(F.col(title).isNotNull()).select(title).distinct().join(cache.select(title), title, "left_anti")
