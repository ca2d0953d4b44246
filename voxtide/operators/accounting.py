"""Event volumes: age filter, rollups, state merge, windowed counts, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.config import DEFAULTS, Settings
from voxtide.functions import scoring
from voxtide.functions.text import or_default

STATE = ["risk_event_volume", "initial_timestamp", "last_active_timestamp"]


def countable(voices: DataFrame, as_of: Column, s: Settings = DEFAULTS, time_col: str = "gmt_create") -> DataFrame:
    """Voices that count for volumes: not suppressed, and at most ``event_max_age_hours`` old (a missing time doesn't count)."""
    kept = voices.where(F.col(time_col) >= as_of - F.expr(f"INTERVAL {s.event_max_age_hours} HOURS"))
    return kept.where(~F.col("decision").eqNullSafe("suppress_as_false_positive")) if "decision" in voices.columns else kept


def rollup(voices: DataFrame, key: str = "risk_event_id", order: str = "id", time_col: str = "gmt_create", title_col: str = "title", also: Sequence[Column] = ()) -> DataFrame:
    """A row of each event: delta, title of its first voice, earliest time, and the aggregates ``also``. Partial sums before the shuffle."""
    return voices.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("delta"), or_default(F.min_by(title_col, order), "Unknown Title").alias("risk_event_title"), F.min(time_col).alias("first_time"), *also)


def split_known(deltas: DataFrame, events: DataFrame, key: str = "risk_event_id") -> tuple[DataFrame, DataFrame]:
    """(new, known) events of a batch."""
    return deltas.join(events, key, "left_anti"), deltas.join(events, key, "left_semi")


def merge_volumes(events: DataFrame, deltas: DataFrame, as_of: Column) -> DataFrame:
    """Event state after a batch: volumes add up, a touched event was last active now, a new one when it began."""
    d = deltas.select("risk_event_id", F.col("delta").alias("_delta"), F.col("first_time").alias("_first"))
    both = events.withColumn("_known", F.lit(True)).join(d, "risk_event_id", "full")
    touched, new = F.col("_delta").isNotNull(), F.col("_known").isNull()
    return (
        both.withColumn("risk_event_volume", (F.coalesce("risk_event_volume", F.lit(0)) + F.coalesce("_delta", F.lit(0))).cast("long"))
        .withColumn("last_active_timestamp", F.when(new, F.col("_first")).when(touched, as_of).otherwise(F.col("last_active_timestamp")))
        .withColumn("initial_timestamp", F.coalesce("initial_timestamp", "_first"))
        .withColumn("status", F.coalesce("status", F.lit("active")))
        .select(*events.columns)
    )


def incremental_volume(mapping: DataFrame, as_of: Column, s: Settings = DEFAULTS, ids: DataFrame | None = None) -> DataFrame:
    """Voices of each event since the alert window began (no upper end)."""
    kept = mapping.where(F.col("voice_date") >= as_of - F.expr(f"INTERVAL {s.alert_window_hours} HOURS"))
    kept = kept.join(ids, "risk_event_id", "left_semi") if ids is not None else kept
    return kept.groupBy("risk_event_id").agg(F.count("voice_id").alias("incremental_volume"))


def rolling_volume(voices: DataFrame, seconds: int, key: str, time_col: str, id_col: str) -> DataFrame:
    """Each voice with the number of voices of its key in the ``seconds`` up to it (its own instant included)."""
    at = F.unix_timestamp(F.col(time_col).cast("timestamp"))
    span = W.partitionBy(key).orderBy("_at").rangeBetween(-seconds, 0)
    return voices.withColumn("_at", at).select(id_col, key, time_col, F.count("*").over(span).alias("volume"))


def alerts(checks: DataFrame, as_of: Column, s: Settings = DEFAULTS) -> DataFrame:
    """``checks``: events that passed the thresholds, with state (known, threshold_breach_timestamp, last_alerted_timestamp, first_time).

    Adds alert_type (null: hold) and the state's timestamps after it.
    """
    kind = scoring.alert_type(F.col("known"), F.col("threshold_breach_timestamp"), F.col("last_alerted_timestamp"), as_of, s)
    breach = F.when(F.col("known"), F.coalesce("threshold_breach_timestamp", as_of)).otherwise(F.col("first_time"))
    return checks.withColumn("alert_type", kind).withColumn("new_breach", breach).withColumn("new_alerted", F.when(F.col("alert_type").isNotNull(), as_of).otherwise(F.col("last_alerted_timestamp")))
