"""Vehicles, their sizes and sources: merging dimensions, counting combinations, lookups by either of two keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_sizes(rows: DataFrame, keys: list[str], size: str, filled: list[str], flag: str) -> DataFrame:
    """One row per size of a key: the first filled value of each column (by value), and whether any row has the flag."""
    return rows.groupBy(*keys, size).agg(*[F.min(c).alias(c) for c in filled], F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag))


def size_list(rows: DataFrame, keys: list[str], size: str, diameter: str) -> DataFrame:
    """(keys, sizes): each key's sizes in the order of diameter, then size."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(diameter).alias("d"), F.col(size).alias("s"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["s"]).alias("sizes"))


def years(first: Column, last: Column, now: Column) -> Column:
    """All years from first to last, or to now where last is open; empty if they are out of order."""
    end = F.coalesce(last, now)
    return F.when(first.isNotNull() & (first <= end), F.sequence(first, end)).otherwise(F.array().cast("array<int>"))


def overlapping(first: Column, last: Column, low: Column, high: Column, keep_open: bool) -> Column:
    """Whether [first, last] meets [low, high]; ranges with an open bound hold only where keep_open says so."""
    meets = (last >= low) & (first <= high)
    return F.coalesce(F.coalesce(last >= low, F.lit(True)) & F.coalesce(first <= high, F.lit(True)) if keep_open else meets, F.lit(False))


def top_pairs(rows: DataFrame, make: str, model: str, at: str, n: int) -> DataFrame:
    """The n most frequent pairs whatever their case: shown name (the smallest), count, first and last time; ties by name."""
    grouped = rows.groupBy(F.lower(make).alias("_make"), F.lower(model).alias("_model"))
    counted = grouped.agg(F.min(make).alias("make"), F.min(model).alias("model"), F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return counted.orderBy(F.desc("n"), "_make", "_model").limit(n).drop("_make", "_model")


def median_age(rows: DataFrame, keys: list[Column], days: Column, at: Column, now: Column, look_back: int = 90, least: int = 5) -> DataFrame:
    """Median of the days online that were seen within look_back days, rounded (halves to even), where at least ``least`` were."""
    kept = rows.where((days >= 0) & (at >= now - F.expr(f"INTERVAL {look_back} DAY")))
    found = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.bround(F.percentile(days, 0.5), 0).cast("long").alias("median_days"))
    return found.where(F.col("samples") >= least)


def combinations(rows: DataFrame, keys: list[str], source: str, filled: list[str]) -> DataFrame:
    """Per combination of keys: its rows, its distinct sources, and the smallest filled value of each column."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("sources"), *[F.min(c).alias(c) for c in filled])


def new_only(found: Column, stored: Column) -> Column:
    """What is found and not stored yet, sorted."""
    return F.array_sort(F.array_except(found, F.coalesce(stored, F.array().cast("array<string>"))))


def matched_either(rows: DataFrame, vehicles: DataFrame, row_id: str) -> DataFrame:
    """(row, vehicle) by vehicle_id or, without one, by make and model whatever their case: two equi-joins, not one with OR."""
    v = vehicles.select(F.col("vehicle_id").alias("_v"), F.lower("make").alias("_make"), F.lower("model").alias("_model"))
    by_id = rows.where("vehicle_id is not null").join(v, F.col("vehicle_id") == F.col("_v")).select(row_id, F.col("_v").alias("vehicle"))
    named = rows.where("vehicle_id is null").join(v, (F.lower("make") == F.col("_make")) & (F.lower("model") == F.col("_model"))).select(row_id, F.col("_v").alias("vehicle"))
    return by_id.unionByName(named)


def counted_either(rows: DataFrame, vehicles: DataFrame, n: str) -> DataFrame:
    """(vehicle, n): the rows that matched_either finds for each vehicle, without making them. A row stands for n equal ones.

    Rows are counted by vehicle_id, or by their name, before they meet vehicles.
    """
    v = vehicles.select(F.col("vehicle_id").alias("_v"), F.lower("make").alias("_make"), F.lower("model").alias("_model"))
    ids = rows.where("vehicle_id is not null").groupBy("vehicle_id").agg(F.sum(n).alias("n"))
    names = rows.where("vehicle_id is null").groupBy(F.lower("make").alias("_m"), F.lower("model").alias("_t")).agg(F.sum(n).alias("n"))
    by_id = ids.join(v, F.col("vehicle_id") == F.col("_v")).select(F.col("_v").alias("vehicle"), "n")
    named = names.join(v, (F.col("_m") == F.col("_make")) & (F.col("_t") == F.col("_model"))).select(F.col("_v").alias("vehicle"), "n")
    return by_id.unionByName(named).groupBy("vehicle").agg(F.sum("n").alias("n"))


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
