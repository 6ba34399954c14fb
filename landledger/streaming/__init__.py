"""Structured Streaming forms: windowed yield, first sightings, running state per property."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def windowed_yield(events: DataFrame, ts: str, key: str, value: str, window: str = "7 days", late: str = "1 day", start: str | None = None) -> DataFrame:
    """Sightings and value per key and tumbling window (from ``start`` behind the epoch on; "4 days" for weeks from Monday); rows later than the watermark are dropped by the engine."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = e.groupBy(F.window("_ts", window, startTime=start).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_sightings(events: DataFrame, ts: str, keys: list[str], late: str = "14 days") -> DataFrame:
    """The first row of each key within the watermark; state older than it is forgotten."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "property_id bigint, ts timestamp, status string"


class StatusProcessor(StatefulProcessor):
    """State of a property: who shows it (a map, so a sighting touches its own source's entry), its status and its last sighting."""

    def __init__(self, stale_after_days: int, forget_after_days: int):
        self.stale_after, self.forget_after = timedelta(days=stale_after_days), timedelta(days=forget_after_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getMapState("shown", "source_id bigint", "since timestamp")
        self.now = handle.getValueState("now", "status string, last timestamp")

    def _wake(self, at: datetime) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at.replace(tzinfo=UTC).timestamp() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, last = self.now.get() if self.now.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values("seq")
        out: list[tuple[datetime, str]] = []
        for source, verifies, visible, at in zip(batch["source_id"], batch["verifies"], batch["visible"], batch["ts"], strict=True):
            source, at = (int(source),), at.to_pydatetime()
            # Rows of a batch come before its timers: what silence did in between is made up for here.
            if last is not None and at - last > self.stale_after and status not in ("removed", "stale"):
                status = "stale"
                out.append((last, status))
            if last is not None and at - last > self.forget_after:
                self.shown.clear()
                status = None
            last = at if last is None else max(at, last)
            if verifies and visible:
                self.shown.updateValue(source, (at,))
                status = "active"
            elif verifies:
                self.shown.removeKey(source)
                status = status or "discovered"
                if next(iter(self.shown.keys()), None) is None:
                    status = "removed"
            elif status in (None, "removed", "stale", "expired"):
                status = "discovered"
            out.append((at, status))
        self.now.update((status, last))
        self._wake(last + self.stale_after)
        yield pd.DataFrame({"property_id": key[0], "ts": [t for t, _ in out], "status": [x for _, x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.now.exists():
            return
        status, last = self.now.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= int((last + self.forget_after).replace(tzinfo=UTC).timestamp() * 1000):
            self.shown.clear()
            self.now.clear()
            return
        self._wake(last + self.forget_after)
        if status not in ("removed", "stale"):
            self.now.update(("stale", last))
            yield pd.DataFrame({"property_id": [key[0]], "ts": [last], "status": ["stale"]})

    def close(self) -> None:
        pass


def running_status(log: DataFrame, stale_after_days: int = 45, forget_after_days: int = 180, late: str = "1 day") -> DataFrame:
    """The status fold over a stream of sightings (property_id, source_id, verifies, visible, ts, seq): a row per sighting, and one when silence makes it stale.

    A property that stays silent for ``forget_after_days`` loses its state; until then a sighting is folded into what its sources showed. Rows older than the
    watermark (``late`` behind the latest) are dropped by the engine.  The session keeps state in RocksDB (``STATE_STORE`` set to ``ROCKS_DB``).
    """
    if log.sparkSession.conf.get(STATE_STORE, "") != ROCKS_DB:
        raise ValueError(f"set {STATE_STORE} to {ROCKS_DB}")
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("property_id", "source_id", "verifies", "visible", "ts", "seq")
    return rows.groupBy("property_id").transformWithStateInPandas(StatusProcessor(stale_after_days, forget_after_days), STATUS, "append", "eventTime")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Rows of a key that follow each other within ``gap`` as one row: session_start, session_end, key, n.  With ``late`` as a stream."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e if late is None else e.withWatermark("_ts", late)
    out = e.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64, order: str = "seq"):
    """Each micro-batch is folded into the state of the buckets it touches (``fold_state.Store`` at ``path``); a batch that is retried changes
    nothing.  Returns the writer, to be started."""
    from ..operators.fold_state import Store

    def one(batch: DataFrame, batch_id: int) -> None:
        Store(batch.sparkSession, path, buckets, order).apply(batch, batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
