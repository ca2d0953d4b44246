"""Scores, thresholds and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtide.config import DEFAULTS, Settings
from voxtide.schemas import DECISION, SUMMARIES


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def decay(last_active: Column, as_of: Column, s: Settings = DEFAULTS) -> Column:
    """exp(-K * days since the last activity); never under 0 days, a missing activity counts as 14 days."""
    # A case and no coalesce: greatest() skips nulls, and would make a missing activity a fresh one.
    since = F.greatest(seconds_between(last_active, as_of), F.lit(0)) / 86400.0
    days = F.when(last_active.isNull(), F.lit(s.missing_activity_days)).otherwise(since)
    return F.exp(F.lit(-s.decay_per_day) * days)


def static_threshold(code: Column, s: Settings = DEFAULTS) -> Column:
    special = [F.lit(x) for pair in s.special_thresholds.items() for x in pair]
    return F.coalesce(F.create_map(*special)[code], F.lit(s.alert_min_incremental)) if special else F.lit(s.alert_min_incremental)


def dynamic_threshold(mean: Column, std: Column, static: Column, s: Settings = DEFAULTS) -> Column:
    """The greater of mean + 2 * max(std, floor) and the static threshold."""
    return F.greatest(mean + 2 * F.greatest(std, F.lit(s.baseline_std_floor)), static.cast("double"))


def verdict(volume: Column, static: Column, samples: Column, threshold: Column, s: Settings = DEFAULTS) -> Column:
    """Why an event alerts or not: the static gate passes at equality, the dynamic one only above."""
    return (
        F.when(volume < static, "below_static")
        .when(samples < s.baseline_min_samples, "alert_without_baseline")
        .when(volume > threshold, "alert")
        .otherwise("below_dynamic")
    )


def alert_type(exists: Column, breached: Column, last_alert: Column, as_of: Column, s: Settings = DEFAULTS) -> Column:
    """first_alert, re_alert or null (hold): new; never breached; alerted longer ago than the silence; breached but never alerted."""
    return (
        F.when(~exists | breached.isNull(), "first_alert")
        .when(last_alert.isNotNull() & (seconds_between(last_alert, as_of) > s.alert_silence_minutes * 60), "re_alert")
        .when(last_alert.isNull(), "re_alert")
    )


def decide(fp_distance: Column, top_score: Column, contexts: Column, s: Settings = DEFAULTS) -> Column:
    """suppress_as_false_positive, create_new (with its reason) or ask: one expression in order of precedence."""
    suppress = (fp_distance <= s.false_positive_distance) if s.suppress_false_positives else F.lit(False)
    return (
        F.when(suppress, "suppress_as_false_positive")
        .when(top_score.isNull(), "create_new:no_candidates")
        .when(top_score < s.decision_score, "create_new:below_threshold")
        .when(F.coalesce(contexts, F.lit(0)) == 0, "create_new:no_context")
        .otherwise("ask")
    )


def final_event_id(decision: Column, matched: Column, cluster: Column) -> Column:
    return F.when(decision == "merge", matched).otherwise(cluster)


def valid_summaries(raw: Column, members: Column, fallback: Column) -> Column:
    """struct(success, summaries): the parsed answer if each member is covered by in-range indices, else one summary of all."""
    parsed = F.from_json(raw, SUMMARIES)["summaries"]
    kept = F.transform(
        F.filter(parsed, lambda x: x["text"].isNotNull() & (F.trim(x["text"]) != "")),
        lambda x: F.struct(F.trim(x["text"]).alias("text"), F.filter(x["original_indices"], lambda i: (i >= 0) & (i < members)).alias("original_indices")),
    )
    kept = F.filter(kept, lambda x: F.size(x["original_indices"]) > 0)
    covered = F.size(F.array_distinct(F.flatten(F.transform(kept, lambda x: x["original_indices"])))) == members
    every = F.array(F.struct(fallback.alias("text"), F.transform(F.sequence(F.lit(0), members - 1), lambda i: i.cast("int")).alias("original_indices")))
    good = F.coalesce(covered, F.lit(False))
    return F.struct(good.cast("int").alias("success"), F.when(good, kept).otherwise(every).alias("summaries"))


def valid_decision(raw: Column, candidates: Column, top_id: Column, top_score: Column, s: Settings = DEFAULTS) -> Column:
    """struct(decision, matched_risk_event_id, source): a merge must name a candidate; else the score decides."""
    parsed = F.from_json(raw, DECISION)
    matched = parsed["matched_risk_event_id"]
    merge = (parsed["decision"] == "merge") & F.array_contains(candidates, matched)
    fresh = parsed["decision"] == "create_new"
    by_score = F.coalesce(top_score >= s.decision_score, F.lit(False))
    return F.struct(
        F.when(merge | (~F.coalesce(fresh, F.lit(False)) & by_score), "merge").otherwise("create_new").alias("decision"),
        F.when(merge, matched).when(F.coalesce(fresh, F.lit(False)), F.lit(None)).when(by_score, top_id).alias("matched_risk_event_id"),
        F.when(merge | fresh, "model").otherwise("fallback").alias("source"),
    )
