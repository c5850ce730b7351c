"""Structured Streaming forms: daily counts, cooldowns, sessions, and continuous upserts of price statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lookup import upserted


def daily_counts(events: DataFrame, ts: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Events a day and key; a day is final once the watermark passes it."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day"), key).count().select(F.col("window.start").alias("day"), key, "count")


def cooled_down(events: DataFrame, ts: str, keys: list[str], gap: str = "5 minutes") -> DataFrame:
    """At most one event per key within the watermark's delay: the cooldown of expansions and collections."""
    return events.withWatermark(ts, gap).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key).count().select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "count")


def upserting(stream: DataFrame, path: str, checkpoint: str, keys: list[str], latest: str) -> StreamingQuery:
    """Merge each batch into a Parquet table: versions lie side by side, so a failed batch leaves the last one whole."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = f"{path}/version={number}"
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}")
            batch = upserted(old, batch, keys, F.desc(latest))
        else:
            batch = upserted(batch.limit(0), batch, keys, F.desc(latest))
        batch.write.mode("overwrite").parquet(out)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
