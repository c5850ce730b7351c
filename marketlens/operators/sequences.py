"""Operators along an order: islands of consecutive values, running totals up to a threshold, occurrence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, first, last, n): runs of consecutive whole values, repeated values once."""
    order = Window.partitionBy(*keys).orderBy(value)
    marked = rows.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(order))
    return marked.groupBy(*keys, "_island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def first_reaching(steps: DataFrame, keys: list[str], order: str, amount: str, enough: int) -> DataFrame:
    """(keys, reached_at, total): the first step at which the running total reaches enough; null if it never does."""
    running = F.sum(amount).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    summed = steps.withColumn("_sum", running)
    return summed.groupBy(*keys).agg(F.min(F.when(F.col("_sum") >= enough, F.col(order))).alias("reached_at"), F.sum(amount).alias("total"))


def occurrences(rows: DataFrame, keys: list[str], *order, fallback: Column | None = None) -> DataFrame:
    """occurrence: the how-manieth row of its key this one is; severity by it, high at least where fallback holds."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    sure = F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))
    level = F.when(F.col("occurrence") >= 5, "critical").when((F.col("occurrence") >= 3) | sure, "high").when(F.col("occurrence") >= 2, "medium").otherwise("low")
    return rows.withColumn("occurrence", n).withColumn("severity", level)
