"""A work queue as set operations: expansion, guards, leases, retries and quarantine; `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import only_in

#: Lease in minutes, attempts that fail a job, failures and days that quarantine, days of freshness.
LEASE_MINUTES, MOST_ATTEMPTS, LOW_DATA_FAILURES, LOOK_BACK_DAYS, FRESH_DAYS = 30, 3, 3, 7, 7


def expanded(seeds: DataFrame, regions: DataFrame) -> DataFrame:
    """Jobs from seeds (make, model, year, region, fuel): other regions, then neighbouring years; the lowest priority
    number of equal jobs stays. Regions are a small dimension."""
    columns = ["make", "model", "year", "region", "fuel"]
    elsewhere = seeds.crossJoin(F.broadcast(regions.select(F.col("region").alias("_r")))).where("_r <> region").withColumn("region", F.col("_r")).select(*columns, F.lit(1).alias("priority"))
    years = seeds.withColumn("year", F.explode(F.array(F.col("year") - 1, F.col("year") + 1))).select(*columns, F.lit(4).alias("priority"))
    return elsewhere.unionByName(years).groupBy(*columns).agg(F.min("priority").alias("priority"))


def admissible(candidates: DataFrame, fresh: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with neither a fresh price nor an active job."""
    return only_in(only_in(candidates, fresh, keys), active, keys)


def reclaimed(jobs: DataFrame, now: Column) -> DataFrame:
    """Assigned jobs whose lease has run out are pending again."""
    stale = (F.col("status") == "assigned") & (F.col("assigned_at") < now - F.make_dt_interval(mins=F.lit(LEASE_MINUTES)))
    return jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("assigned_at", F.when(~stale, F.col("assigned_at")))


def quarantined(jobs: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Pending and assigned jobs of keys with LOW_DATA_FAILURES recent failures are cancelled."""
    recent = (F.col("status") == "failed") & (F.col("completed_at") >= now - F.make_dt_interval(F.lit(LOOK_BACK_DAYS)))
    low = jobs.where(recent).groupBy(*keys).count().where(F.col("count") >= LOW_DATA_FAILURES).select(*keys, F.lit(True).alias("_low"))
    hit = F.coalesce("_low", F.lit(False)) & F.col("status").isin("pending", "assigned")
    return jobs.join(low, keys, "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_low")


def picked(jobs: DataFrame, per: str, n: int) -> DataFrame:
    """The first n pending jobs of each value of per by priority, age and id."""
    order = Window.partitionBy(per).orderBy("priority", "created_at", "job_id")
    return jobs.where("status = 'pending'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def finished(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after outcomes (job_id, ok): done, or one more attempt, failed at MOST_ATTEMPTS; only assigned jobs change."""
    joined = jobs.join(outcomes, "job_id", "left")
    mine = F.col("ok").isNotNull() & (F.col("status") == "assigned")
    attempts = F.col("attempts") + F.when(mine & ~F.col("ok"), 1).otherwise(0)
    status = F.when(mine & F.col("ok"), "done").when(mine & (attempts >= MOST_ATTEMPTS), "failed").when(mine, "pending").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "attempts": attempts}).drop("ok")
