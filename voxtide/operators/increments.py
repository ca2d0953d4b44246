"""Counts that a snapshot or a baseline reads without reading voices again: prefix sums by hour, and moments by hour of day.

Prefix sums: each event has, for every hour with voices, the number of voices up to its end. The count of an interval is the difference
of two of them, plus the voices of the two hours that its ends lie in. New voices only change their own events' later hours.

Moments: the volumes of an event at one hour of the day, one a day, as number, sum and sum of squares, which are merged and taken back in
whole numbers. Days without voices count 0, so their number is the window's.

Defined cases: events without voices count 0; rows without an event or a time are left out; an interval that ends before it begins counts
0; empty tables give no rows; voices count as often as their rows, ids that are null not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.config import DEFAULTS, Settings
from voxtide.functions import scoring
from voxtide.operators.snapshot import active_events, last_snapshots

HOUR = 3_600_000_000
#: Rows that a task sorts and joins at a time, on average.
ROWS = 1 << 18


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def hour_of(time: Column) -> Column:
    return F.floor(micros(time) / HOUR)


def tasks_for(*tables: DataFrame) -> int:
    """Tasks over which events are dealt, so that none has many more than ``ROWS`` of the tables' rows."""
    context = tables[0].sparkSession.sparkContext
    return max(context.defaultParallelism, -(-sum(t.count() for t in tables) // ROWS))


def extended(prefix: DataFrame | None, voices: DataFrame) -> DataFrame:
    """risk_event_id, hour, n, upto: ``prefix`` (an earlier result, or none) with more ``voices``.

    Voices and earlier counts are dealt by their event once; a task counts its events' hours and sums them up.
    """
    rows = voices.where("risk_event_id IS NOT NULL AND voice_date IS NOT NULL")
    rows = rows.select("risk_event_id", hour_of(F.col("voice_date")).alias("hour"), F.col("voice_id").isNotNull().cast("long").alias("n"))
    parts = tasks_for(voices) if prefix is None else tasks_for(prefix, voices)
    rows = rows if prefix is None else prefix.select(*rows.columns).unionByName(rows)
    counted = rows.repartition(parts, "risk_event_id").groupBy("risk_event_id", "hour").agg(F.sum("n").alias("n"))
    up = W.partitionBy("risk_event_id").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("n").over(up))


def interval_counts(intervals: DataFrame, prefix: DataFrame, voices: DataFrame) -> DataFrame:
    """``intervals`` (risk_event_id, low, closed, high) with n: voices in (low, high], or [low, high] where ``closed``.

    Each end reads one prefix sum, that of the hours before its own, and the voices of its own hour alone. All three tables are dealt by
    their event, over as many tasks as their rows ask for (the hour is no key of a join, which would deal them anew).
    """
    parts = tasks_for(prefix, voices)
    ends = F.array(F.struct(F.lit(1).alias("sign"), F.col("high").alias("at"), F.lit(True).alias("own")), F.struct(F.lit(-1).alias("sign"), F.col("low").alias("at"), (~F.col("closed")).alias("own")))
    edges = intervals.where("low <= high").select("risk_event_id", F.explode(ends).alias("e")).select("risk_event_id", "e.*").withColumn("hour", hour_of(F.col("at"))).repartition(parts, "risk_event_id")
    before = edges.join(prefix.select("risk_event_id", F.col("hour").alias("h"), "upto").repartition(parts, "risk_event_id"), "risk_event_id").where("h < hour")
    before = before.groupBy("risk_event_id", "sign").agg(F.max("upto").alias("k")).select("risk_event_id", (F.col("sign") * F.col("k")).alias("k"))
    near = voices.where("risk_event_id IS NOT NULL AND voice_date IS NOT NULL").select("risk_event_id", "voice_id", "voice_date").repartition(parts, "risk_event_id")
    near = near.join(edges, "risk_event_id").where(hour_of(F.col("voice_date")) - F.col("hour") == 0)
    near = near.where((F.col("voice_date") < F.col("at")) | (F.col("own") & (F.col("voice_date") == F.col("at")))).where("voice_id IS NOT NULL").select("risk_event_id", F.col("sign").cast("long").alias("k"))
    n = before.unionByName(near).groupBy("risk_event_id").agg(F.sum("k").alias("n"))
    return intervals.join(n, "risk_event_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def snapshot(events: DataFrame, timeline: DataFrame, prefix: DataFrame, voices: DataFrame, as_of: Column, s: Settings = DEFAULTS, cutoff: Column | None = None) -> DataFrame:
    """As ``operators.snapshot.snapshot``, from prefix sums."""
    cutoff = cutoff if cutoff is not None else as_of - F.expr(f"INTERVAL {s.snapshot_lookback_hours} HOURS")
    active = active_events(events, cutoff).select("risk_event_id", "risk_event_volume", "initial_timestamp").join(last_snapshots(timeline), "risk_event_id", "left")
    due = active.select("risk_event_id", "risk_event_volume", F.coalesce("last_snapshot", "initial_timestamp").alias("low"), F.col("last_snapshot").isNull().alias("closed"), as_of.alias("high"))
    counted = interval_counts(due, prefix, voices)
    return counted.select("risk_event_id", F.col("high").alias("snapshot_time"), F.col("risk_event_volume").alias("volume_at_snapshot"), F.col("n").alias("incremental_volume_at_snapshot"))


def hour_volumes(timeline: DataFrame) -> DataFrame:
    """risk_event_id, hour, n: the volume of the snapshots in (hour - 1, hour], hours by their end."""
    at = F.ceil(micros(F.col("snapshot_time")) / HOUR)
    return timeline.where("risk_event_id IS NOT NULL AND snapshot_time IS NOT NULL").groupBy("risk_event_id", at.alias("hour")).agg(F.sum("incremental_volume_at_snapshot").alias("n"))


def moments(checks: DataFrame, volumes: DataFrame, s: Settings = DEFAULTS, code: str = "gm_code") -> DataFrame:
    """``checks`` (risk_event_id, as_of at a full hour, a code) judged against the same hour of the ``baseline_days`` days before.

    One window over the days of an event and hour of day: each volume is read once, not once a day that it is held against.
    """
    asked = checks.withColumn("hour", micros(F.col("as_of")) / HOUR).withColumn("hour", F.col("hour").cast("long"))
    marks = asked.select("risk_event_id", "hour").distinct().withColumn("n", F.lit(0).cast("long"))
    cells = volumes.select("risk_event_id", "hour", "n").unionByName(marks).groupBy("risk_event_id", "hour").agg(F.sum("n").alias("n"))
    span = W.partitionBy("risk_event_id", F.pmod("hour", F.lit(24))).orderBy(F.floor(F.col("hour") / 24)).rangeBetween(-s.baseline_days, -1)
    days = F.lit(s.baseline_days)
    summed = cells.withColumn("_s1", F.coalesce(F.sum("n").over(span), F.lit(0))).withColumn("_s2", F.coalesce(F.sum(F.col("n") * F.col("n")).over(span), F.lit(0)))
    out = asked.join(summed.withColumnRenamed("n", "volume"), ["risk_event_id", "hour"]).withColumn("historical_mean", F.col("_s1") / days)
    square = days * F.col("_s2") - F.col("_s1") * F.col("_s1")  # of whole numbers: exact
    out = out.withColumn("historical_std", F.sqrt(square / (days * (days - 1))) if s.baseline_days > 1 else F.lit(0.0)).withColumn("static_threshold", scoring.static_threshold(F.col(code), s))
    out = out.withColumn("threshold", scoring.dynamic_threshold(F.col("historical_mean"), F.col("historical_std"), F.col("static_threshold"), s))
    return out.withColumn("verdict", scoring.verdict(F.col("volume"), F.col("static_threshold"), days, F.col("threshold"), s)).drop("hour", "_s1", "_s2")
