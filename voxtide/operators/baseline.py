"""Dynamic-baseline alerts: the volume of a window against the same window on previous days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.config import DEFAULTS, Settings
from voxtide.functions import scoring


def history(checks: DataFrame, timeline: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``checks`` (risk_event_id, as_of, ...) with the volumes of the window (as_of - w, as_of] now and on each previous day.

    For any ``as_of``: windows join the timeline on the event and on the hour that a snapshot falls in, of which a
    window touches w + 1; so no check meets an event's whole timeline. Days without snapshots count 0.
    """
    hours, days = s.alert_window_hours, s.baseline_days
    end = F.unix_micros(F.col("as_of").cast("timestamp")) - F.col("day") * 86_400_000_000
    windows = checks.select("risk_event_id", "as_of").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("end", end)
    first = F.floor((F.col("end") - hours * 3_600_000_000) / 3_600_000_000)
    touched = windows.withColumn("hour", F.explode(F.sequence(first, F.floor(F.col("end") / 3_600_000_000))))
    at = F.unix_micros(F.col("snapshot_time").cast("timestamp"))
    points = timeline.select(F.col("risk_event_id"), at.alias("at"), F.floor(at / 3_600_000_000).alias("hour"), F.col("incremental_volume_at_snapshot").alias("n"))
    inside = touched.join(points, ["risk_event_id", "hour"]).where((F.col("at") > F.col("end") - hours * 3_600_000_000) & (F.col("at") <= F.col("end")))
    sums = inside.groupBy("risk_event_id", "as_of").agg(*[F.coalesce(F.sum(F.when(F.col("day") == d, F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(days + 1)])
    joined = checks.join(sums, ["risk_event_id", "as_of"], "left")
    past = F.array(*[F.coalesce(F.col(f"d{d}"), F.lit(0)) for d in range(1, days + 1)])
    return joined.withColumn("volume", F.coalesce("d0", F.lit(0))).withColumn("history", past).drop(*[f"d{d}" for d in range(days + 1)])


def judged(checks: DataFrame, s: Settings = DEFAULTS, code: str = "gm_code") -> DataFrame:
    """Checks with volume and history: mean, sample deviation, thresholds and verdict."""
    n = F.size("history")
    mean = F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / n
    out = checks.withColumn("historical_mean", mean)
    square = F.aggregate("history", F.lit(0.0), lambda a, x: a + (x - F.col("historical_mean")) * (x - F.col("historical_mean")))
    out = out.withColumn("historical_std", F.when(n > 1, F.sqrt(square / (n - 1))).otherwise(0.0))
    out = out.withColumn("static_threshold", scoring.static_threshold(F.col(code), s))
    out = out.withColumn("threshold", scoring.dynamic_threshold(F.col("historical_mean"), F.col("historical_std"), F.col("static_threshold"), s))
    return out.withColumn("verdict", scoring.verdict(F.col("volume"), F.col("static_threshold"), n, F.col("threshold"), s))
