"""Periodic snapshots of event volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.config import DEFAULTS, Settings


def active_events(events: DataFrame, cutoff: Column, with_activity: bool = False) -> DataFrame:
    """Active events whose latest of the start, breach and alert times (option: activity too) is at or after the cutoff."""
    times = ["initial_timestamp", "threshold_breach_timestamp", "last_alerted_timestamp"] + ["last_active_timestamp"] * with_activity
    latest = F.greatest(*[F.coalesce(t, F.lit("1970-01-01").cast("timestamp_ntz")) for t in times])
    return events.where((F.col("status") == "active") & (latest >= cutoff))


def last_snapshots(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("risk_event_id").agg(F.max("snapshot_time").alias("last_snapshot"))


def snapshot(events: DataFrame, timeline: DataFrame, mapping: DataFrame, as_of: Column, s: Settings = DEFAULTS, cutoff: Column | None = None) -> DataFrame:
    """Timeline rows of the active events at ``as_of``; voices count in (last snapshot, now], or from the event's start if it has none.

    One equi-join on the event with the interval as its residual; counts are partial before the shuffle.
    """
    cutoff = cutoff if cutoff is not None else as_of - F.expr(f"INTERVAL {s.snapshot_lookback_hours} HOURS")
    active = active_events(events, cutoff).select("risk_event_id", "risk_event_volume", "initial_timestamp").join(last_snapshots(timeline), "risk_event_id", "left")
    voices = mapping.where(F.col("voice_date") <= as_of).select("risk_event_id", "voice_id", "voice_date")
    due = F.when(F.col("last_snapshot").isNotNull(), F.col("voice_date") > F.col("last_snapshot")).otherwise(F.col("voice_date") >= F.col("initial_timestamp"))
    counts = voices.join(active.select("risk_event_id", "initial_timestamp", "last_snapshot"), "risk_event_id").where(due).groupBy("risk_event_id").agg(F.count("voice_id").alias("n"))
    out = active.join(counts, "risk_event_id", "left")
    return out.select("risk_event_id", as_of.alias("snapshot_time"), F.col("risk_event_volume").alias("volume_at_snapshot"), F.coalesce("n", F.lit(0)).alias("incremental_volume_at_snapshot"))
