"""The endless worker as a streaming query: the batch functions inside ``foreachBatch``, over tables that a replay rewrites."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxtide import models, schemas
from voxtide.config import DEFAULTS, Settings
from voxtide.operators.snapshot import active_events, last_snapshots, snapshot
from voxtide.plans.stages import manage_events
from voxtide.sources.shared import scratch, work_folder
from voxtide.sources.sinks import EpochTable, StateTable

__all__ = ["Worker", "cadence", "drained", "file_stream", "first_seen", "windowed_counts", "work_folder"]


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the columns of a schema; those that it lacks are null."""
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


class Worker:
    """Event state, mapping, timeline, alerts and knowledge of a stream of voices.

    ``decide`` turns a micro-batch into decided voices (``schemas.DECIDED``, or some of its columns). What it decides is written under the
    batch's epoch first, and read by all that follows: models are asked once a batch, and an epoch that is processed again
    takes the decisions that stand, whatever the models would say now. A batch reads only what earlier epochs wrote and owns its
    own epoch's folders, so a folder belongs to one checkpoint. Its clock is the batch's latest event time, unless ``clock`` says otherwise.
    ``embedder``, if given, makes the vectors under which new events are found by later batches.
    """

    def __init__(self, spark: SparkSession, folder: str, decide: Callable[[DataFrame], DataFrame] | None = None, s: Settings = DEFAULTS, clock: Callable[[DataFrame], Column] | None = None, embedder=None) -> None:
        self.spark, self.decide, self.settings, self.clock, self.embedder = spark, decide, s, clock, embedder
        self.events = StateTable(spark, f"{folder}/risk_event", schemas.RISK_EVENT)
        self.decided = EpochTable(spark, f"{folder}/decided", schemas.DECIDED)
        self.mapping = EpochTable(spark, f"{folder}/voice_mapping", schemas.VOICE_MAPPING, "voice_date")
        self.timeline = EpochTable(spark, f"{folder}/volume_timeline", schemas.VOLUME_TIMELINE, "snapshot_time")
        self.alerts = EpochTable(spark, f"{folder}/alert_record", schemas.ALERT_RECORD)
        self.knowledge = EpochTable(spark, f"{folder}/knowledge", schemas.KNOWLEDGE)
        for t in (self.events, self.decided, self.mapping, self.timeline, self.alerts, self.knowledge):
            t.ensure()

    def decisions(self, batch: DataFrame, epoch: int) -> DataFrame:
        return self.decide(batch)

    def now(self, rows: DataFrame) -> Column | None:
        """The batch's time; none if it is empty."""
        if self.clock:
            return self.clock(rows)
        latest = rows.agg(F.max("gmt_create").alias("t")).first()["t"]
        return None if latest is None else F.lit(latest).cast("timestamp_ntz")

    def process(self, batch: DataFrame, epoch: int) -> None:
        """One epoch; the tables that it writes on its way are gone when it ends."""
        with scratch():
            self._process(batch, epoch)

    def _process(self, batch: DataFrame, epoch: int) -> None:
        if not self.decided.has(epoch):
            self.decided.write(shaped(self.decisions(batch, epoch), schemas.DECIDED), epoch)
        decided = self.decided.epoch(epoch)
        as_of = self.now(decided)
        if as_of is None:
            return
        s = self.settings
        mapping = self.mapping.read(before=epoch, since=as_of - F.expr(f"INTERVAL {s.alert_window_hours} HOURS"))
        recent = self.timeline.read(before=epoch, since=as_of - F.expr(f"INTERVAL {s.baseline_days + 1} DAYS"))
        out = manage_events(decided, self.events.version(before=epoch), mapping, recent, as_of, s)
        self.mapping.write(out.mapping, epoch)
        self.events.write(out.events, epoch)
        self.alerts.write(out.alerts, epoch)
        if self.embedder is not None:
            known = models.embedded(out.knowledge, "risk_event_id", "risk_event_title", self.embedder)
            self.knowledge.write(shaped(known.where("embedding IS NOT NULL"), schemas.KNOWLEDGE), epoch)
        self._snapshot(self.timeline.read(before=epoch), as_of, epoch)

    def _snapshot(self, timeline: DataFrame, as_of: Column, epoch: int) -> None:
        """Timeline rows if the heartbeat is due since the last ones."""
        s = self.settings
        due = timeline.agg(F.max("snapshot_time").alias("t")).where(F.col("t").isNull() | (F.col("t") + F.expr(f"INTERVAL {s.snapshot_minutes} MINUTES") <= as_of))
        if due.isEmpty():
            return
        events = self.events.version(before=epoch + 1)
        active = active_events(events, as_of - F.expr(f"INTERVAL {s.snapshot_lookback_hours} HOURS")).join(last_snapshots(timeline), "risk_event_id", "left")
        begin = active.agg(F.min(F.coalesce("last_snapshot", "initial_timestamp")).alias("t")).first()["t"]  # no voice before it is counted
        since = as_of if begin is None else F.lit(begin).cast("timestamp_ntz")
        self.timeline.write(snapshot(events, timeline, self.mapping.read(before=epoch + 1, since=since), as_of, s), epoch)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "2 minutes"})).start()


def cadence(start: Callable[[], StreamingQuery], every: float = 120.0, pause: float = 10.0, runs: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Start a run that drains all that is there (``availableNow``), again and again: ``every`` seconds, at once while a run takes longer
    than that, and ``pause`` seconds after a failure. ``runs`` ends it; returns the failures' messages."""
    failures: list[str] = []
    while runs is None or runs > 0:
        began = time.monotonic()
        try:
            start().awaitTermination()
            wait = max(0.0, every - (time.monotonic() - began))
        except Exception as error:  # noqa: BLE001  whatever a run fails with, the next takes up its batch again
            failures = [*failures[-99:], f"{type(error).__name__}: {error}"[:500]]
            wait = pause
        if runs is not None:
            runs -= 1
        if runs != 0:
            sleep(wait)
    return failures


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None, only: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return reader.parquet(folder)


def windowed_counts(stream: DataFrame, time_col: str, key: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts; a window is emitted once the watermark has passed its end."""
    timed = stream.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", width), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


def first_seen(stream: DataFrame, time_col: str, key: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return stream.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, append its rows to Parquet, and read them."""
    folder = work_folder(df.sparkSession, name)
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
