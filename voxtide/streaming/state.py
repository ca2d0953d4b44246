"""Events as keyed stream state: sliding hour, breach, silence, volume and heartbeat live in the state store, one entry an event.

A micro-batch touches the events that it has voices of, and those whose heartbeat is due; the store logs only what changed, so a batch costs
its voices, however many events there are, and a restart takes up where the last committed batch ended. ``alerts`` checks each voice, in the
order of their times, against the voices of the hour up to it; ``snapshots`` counts intervals of ten minutes, which timers of the state
emit once the watermark has passed them, empty ones too.

Scale: the state of an event is the distinct times of its last hour and the intervals that aren't emitted yet. Voices of an event in one
micro-batch meet in one task, as their order decides; ``maxFilesPerTrigger`` or a rate limit of the source bounds them.

Defined cases: voices without an event or a time are left out; voices of one time count together; across batches voices are expected in the
order of their times up to the watermark's delay, later ones are dropped by it; an event without a voice for ``snapshot_lookback_hours`` is forgotten
by the heartbeat, and begins anew with its next voice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from voxtide.config import DEFAULTS, Settings
from voxtide.sources.shared import work_folder

SECOND = 1_000_000
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _times(rows: Iterator[pd.DataFrame]) -> np.ndarray:
    parts = [frame["at"].to_numpy(np.int64) for frame in rows]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


class Watch(StatefulProcessor):
    """Alerts of an event: its hour's volume reaches the gate, and the last alert is over the silence ago."""

    def __init__(self, least: int, window: int, silence: int) -> None:
        self.least, self.window, self.silence = least, window, silence

    def init(self, handle) -> None:
        self.recent = handle.getListState("recent", "at long, n long")
        self.state = handle.getValueState("state", "volume long, breach long, alerted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, counts = np.unique(_times(rows), return_counts=True)
        old = list(self.recent.get()) if self.recent.exists() else []
        volume, breach, alerted = self.state.get() if self.state.exists() else (0, None, None)
        times, back = np.unique(np.concatenate([np.array([r[0] for r in old], np.int64), new]), return_inverse=True)
        n = np.zeros(len(times), np.int64)
        np.add.at(n, back, np.concatenate([np.array([r[1] for r in old], np.int64), counts]))
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.searchsorted(times, new)
        hour = total[place + 1] - total[np.searchsorted(times, new - self.window)]
        over, found = np.flatnonzero(hour >= self.least), []
        at = 0
        while at < len(over):
            now = int(new[over[at]])
            if alerted is None or now - alerted > self.silence:
                found.append((now, int(hour[over[at]]), "first_alert" if breach is None else "re_alert"))
                breach, alerted = now if breach is None else breach, now
            at = int(np.searchsorted(new[over], alerted + self.silence, "right"))
        keep = times >= (times[-1] if len(times) else 0) - self.window
        self.recent.put([(int(t), int(k)) for t, k in zip(times[keep], n[keep], strict=True)])
        self.state.update((volume + int(counts.sum()), breach, alerted))
        if found:
            yield pd.DataFrame({"risk_event_id": key[0], "at": [f[0] for f in found], "volume": [f[1] for f in found], "kind": [f[2] for f in found]})

    def close(self) -> None:
        pass


class Heartbeat(StatefulProcessor):
    """A row for each interval (end - width, end] of an event since its first voice, once the watermark has passed its end."""

    def __init__(self, width: int, lookback: int) -> None:
        self.width, self.lookback = width, lookback

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "end long", "n long")
        self.next = handle.getValueState("next", "end long, latest long, volume long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = _times(rows)
        ends, counts = np.unique(-(-times // self.width) * self.width, return_counts=True)
        if len(ends):
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                self.open.updateValue((end,), ((self.open.getValue((end,))[0] if self.open.containsKey((end,)) else 0) + n,))
            if self.next.exists():
                due, latest, volume = self.next.get()
                self.next.update((min(due, int(ends[0])), max(latest, int(ends[-1])), volume))  # an earlier interval that is still open
            else:
                self.next.update((int(ends[0]), int(ends[-1]), 0))
            self.handle.registerTimer(self.next.get()[0] // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.next.exists():
            return
        due, latest, volume = self.next.get()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last = min(passed // self.width * self.width, latest + self.lookback)
        ends = range(due, last + 1, self.width)
        counts = []
        for end in ends:
            counts.append(self.open.getValue((end,))[0] if self.open.containsKey((end,)) else 0)
            if counts[-1]:
                self.open.removeKey((end,))
        totals = [volume + int(x) for x in np.cumsum(counts)] if counts else []
        following = due + len(ends) * self.width
        if following > latest + self.lookback:  # silent for so long: forgotten
            self.next.clear()
            self.open.clear()
        else:
            self.next.update((following, latest, totals[-1] if totals else volume))
            self.handle.registerTimer(max(following, passed + 1000) // 1000)
        if counts:
            yield pd.DataFrame({"risk_event_id": key[0], "at": list(ends), "volume": totals, "n": counts})

    def close(self) -> None:
        pass


def _keyed(voices: DataFrame, event: str, time: str, late: str) -> DataFrame:
    rows = voices.where(F.col(event).isNotNull() & F.col(time).isNotNull())
    timed = rows.select(F.col(event).cast("string").alias("risk_event_id"), F.col(time).cast("timestamp").alias("_at")).withWatermark("_at", late)
    return timed.withColumn("at", F.unix_micros("_at"))


def _time() -> Column:
    return F.timestamp_micros("at").cast("timestamp_ntz")


def alerts(voices: DataFrame, event: str = "risk_event_id", time: str = "gmt_create", s: Settings = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """risk_event_id, alert_timestamp, volume_at_alert, alert_type of a stream of voices."""
    watch = Watch(s.alert_min_incremental, s.alert_window_hours * 3600 * SECOND, s.alert_silence_minutes * 60 * SECOND)
    keyed = _keyed(voices, event, time, late).groupBy("risk_event_id")
    out = keyed.transformWithStateInPandas(watch, "risk_event_id string, at long, volume long, kind string", "Append", "EventTime")
    return out.select("risk_event_id", _time().alias("alert_timestamp"), F.col("volume").alias("volume_at_alert"), F.col("kind").alias("alert_type"))


def snapshots(voices: DataFrame, event: str = "risk_event_id", time: str = "gmt_create", s: Settings = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """risk_event_id, snapshot_time, volume_at_snapshot, incremental_volume_at_snapshot of a stream of voices."""
    beat = Heartbeat(s.snapshot_minutes * 60 * SECOND, s.snapshot_lookback_hours * 3600 * SECOND)
    keyed = _keyed(voices, event, time, late).groupBy("risk_event_id")
    out = keyed.transformWithStateInPandas(beat, "risk_event_id string, at long, volume long, n long", "Append", "EventTime")
    return out.select("risk_event_id", _time().alias("snapshot_time"), F.col("volume").alias("volume_at_snapshot"), F.col("n").alias("incremental_volume_at_snapshot"))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within it keep their state in RocksDB, which keyed states need."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a stateful stream over all that is there now, append its rows to Parquet, and read them. ``folder``: of an earlier run, to go on from."""
    folder = folder or work_folder(df.sparkSession, name)
    with state_store(df.sparkSession):
        query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
        query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
