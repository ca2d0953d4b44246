"""Matching clusters with known events: candidate filter, time-decayed scores, gates, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.config import DEFAULTS, Settings
from voxtide.functions import scoring
from voxtide.operators.dedup import top_k


def kb_filter(as_of: Column, s: Settings = DEFAULTS, code: str | None = None, source: str | None = None, hard_start: Column | None = None) -> Column:
    """Active events that began at most ``lookback_days`` before the base time, nor before a hard start."""
    base = F.coalesce(hard_start, as_of) if hard_start is not None else as_of
    lower = base - F.expr(f"INTERVAL {s.lookback_days} DAYS")
    test = (F.col("status") == "active") & (F.col("initial_timestamp") >= lower)
    if code is not None:
        test = test & (F.col("gm_code") == code)
    return test & (F.col("data_source") == source) if source is not None else test


def decision_scores(candidates: DataFrame, activity: DataFrame, as_of: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Candidates (cluster_id, risk_event_id, score, rank) with last_active, time_decay_factor, decision_score, decision_rank."""
    known = candidates.join(activity.select(F.col("risk_event_id"), F.col("last_active_timestamp").alias("last_active")), "risk_event_id", "left")
    decay = scoring.decay(F.col("last_active"), as_of, s)
    scored = known.withColumn("time_decay_factor", F.round(decay, 4)).withColumn("decision_score", F.round(F.col("score") * decay, 4))
    return top_k(scored, ["cluster_id"], [F.col("decision_score").desc(), F.col("rank").asc()], 2**31 - 1, "decision_rank")


def search_tasks(voices: DataFrame, s: Settings = DEFAULTS, marker: str = "UNCLUSTERED") -> tuple[DataFrame, DataFrame]:
    """(distinct tasks: cluster_id, gm_code, title, voices; their members: cluster_id, gm_code, title, id) of the voices that may be
    searched for: clustered, with a title and a known code. The list of a task's voices is rows, not an array: it may be long."""
    eligible = voices.where((F.coalesce("batch_cluster_id", F.lit(marker)) != marker) & (F.coalesce("batch_cluster_title", F.lit("")) != ""))
    eligible = eligible.where(F.coalesce("gm_code", F.lit(s.unknown_code)) != s.unknown_code)
    members = eligible.select(F.col("batch_cluster_id").alias("cluster_id"), "gm_code", F.col("batch_cluster_title").alias("title"), "id")
    return members.groupBy("cluster_id", "gm_code", "title").agg(F.count("*").alias("voices")), members


def decisions(clusters: DataFrame, scored: DataFrame, false_positives: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """clusters (cluster_id, contexts) with outcome, the top candidate and its score; ``false_positives``: cluster_id, fp_distance."""
    top = scored.where(F.col("decision_rank") == 1).select("cluster_id", F.col("risk_event_id").alias("top_id"), F.col("decision_score").alias("top_score"))
    joined = clusters.join(top, "cluster_id", "left").join(false_positives, "cluster_id", "left")
    return joined.withColumn("outcome", scoring.decide(F.col("fp_distance"), F.col("top_score"), F.col("contexts"), s))


def resolve(decided: DataFrame, answers: DataFrame | None, scored: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """cluster_id, decision, matched_risk_event_id, final_event_id: asked clusters by the model's validated answer, or by their score."""
    ids = scored.groupBy("cluster_id").agg(F.collect_set("risk_event_id").alias("candidate_ids"))
    asked = decided.join(ids, "cluster_id", "left")
    asked = asked.join(answers, "cluster_id", "left") if answers is not None else asked.withColumn("answer", F.lit(None).cast("string"))
    answer = scoring.valid_decision(F.col("answer"), F.col("candidate_ids"), F.col("top_id"), F.col("top_score"), s)
    parts = asked.withColumn("v", answer).withColumn("ask", F.col("outcome") == "ask")
    decision = F.when(F.col("ask"), F.col("v.decision")).otherwise(F.split_part("outcome", F.lit(":"), F.lit(1)))
    matched = F.when(F.col("ask"), F.col("v.matched_risk_event_id"))
    out = parts.select("cluster_id", decision.alias("decision"), matched.alias("matched_risk_event_id"))
    return out.withColumn("final_event_id", scoring.final_event_id(F.col("decision"), F.col("matched_risk_event_id"), F.col("cluster_id").cast("string")))
