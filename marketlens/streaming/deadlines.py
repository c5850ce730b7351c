"""Deadlines in streams: leases that expire and prices that grow stale, with event-time timers.

Each key holds one deadline. A row that opens sets it anew, a row that closes ends it, and when the watermark passes a
deadline the key's expiry is emitted. Rows of one batch are taken in the order of their times, and a row after the
deadline expires it first, so one batch or many give the same statuses (but for deadlines that the watermark has not
reached). State and timers live in the state store and survive a restart from the checkpoint.

Defined cases: rows that neither open nor close are ignored; closing without an open deadline emits nothing; a row at the
very time of the deadline comes too late; equal times keep the order open before close; null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Minutes of a lease, and hours for which a price is fresh.
LEASE, FRESH = timedelta(minutes=30), timedelta(hours=24)
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_MILLISECOND = timedelta(milliseconds=1)


class Deadlines(StatefulProcessor):
    """Rows (key, kind, at in milliseconds) to rows (key, status, at): kind is open or close."""

    def __init__(self, hold: timedelta, opened: str, closed: str, expired: str):
        self.hold, self.opened, self.closed, self.expired = int(hold / _MILLISECOND), opened, closed, expired

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each call of the state or of a timer is a message to the JVM: both are touched once for a key's rows, not for each row.
        held = self.until.get()
        first = until = held[0] if held else None
        for row in sorted(rows, key=lambda r: (r["at"], r["kind"] != "open")):
            if until is not None and row["at"] >= until:
                yield Row(key=key[0], status=self.expired, at=until)
                until = None
            if row["kind"] == "open":
                until = row["at"] + self.hold
                yield Row(key=key[0], status=self.opened, at=row["at"])
            elif until is not None:
                until = None
                yield Row(key=key[0], status=self.closed, at=row["at"])
        if until != first:
            if first is not None:
                self.handle.deleteTimer(first)
            if until is None:
                self.until.clear()
            else:
                self.until.update((until,))
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] == at:
            self.until.clear()
            yield Row(key=key[0], status=self.expired, at=at)

    def close(self) -> None:
        pass


def with_deadlines(rows: DataFrame, key: str, kind: str, ts: str, hold: timedelta, statuses: tuple[str, str, str], delay: str = "1 hour") -> DataFrame:
    """(key, status, at) of a stream of rows whose column kind is open, close or something else."""
    known = rows.where(F.col(kind).isin("open", "close")).withWatermark(ts, delay)
    slim = known.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), ts)
    found = slim.groupBy("key").transformWithState(Deadlines(hold, *statuses), f"key {rows.schema[key].dataType.simpleString()}, status string, at long", "Append", "EventTime")
    return found.select("key", "status", F.timestamp_millis("at").alias("at"))


def leases(rows: DataFrame, key: str, kind: str, ts: str, hold: timedelta = LEASE, delay: str = "1 hour") -> DataFrame:
    """Jobs that are assigned (open), done (close), or pending again when their lease ends."""
    return with_deadlines(rows, key, kind, ts, hold, ("assigned", "done", "pending"), delay)


def freshness(rows: DataFrame, key: str, ts: str, hold: timedelta = FRESH, delay: str = "1 hour") -> DataFrame:
    """Keys that are fresh from each of their rows on and stale ``hold`` after the last of them."""
    return with_deadlines(rows.withColumn("_kind", F.lit("open")), key, "_kind", ts, hold, ("fresh", "closed", "stale"), delay)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives for all input that is there now: written to path/rows, with its checkpoint beside it."""
    spark: SparkSession = stream.sparkSession
    old = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
