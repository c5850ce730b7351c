"""Robust price statistics, trends, pivots and rates; every one a grouped aggregation with partial sums before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outlier_free(prices: DataFrame, keys: list[str], price: str = "price", least: int = 3) -> DataFrame:
    """Interquartile fence and mean by group.

    The fence is 1.5 interquartile ranges beyond the quartiles of all prices. With fewer than least prices inside, all
    are kept. p25 and p75 are those of the kept prices, iqr_mean the mean of kept prices within them.
    """
    # Prices are counted by value first: what follows reads this one shuffled table, not the prices.
    x, n = F.col(price), F.col("_n")
    counted = prices.where(x.isNotNull()).groupBy(*keys, price).agg(F.count(F.lit(1)).alias("_n"))
    at = lambda value, q: F.percentile(value, F.lit(q), n)
    width = 1.5 * (F.col("q3") - F.col("q1"))
    fence = counted.groupBy(*keys).agg(at(x, 0.25).alias("q1"), at(x, 0.75).alias("q3"), F.sum(n).alias("n"))
    fence = fence.select(*keys, "n", (F.col("q1") - width).alias("fence_low"), (F.col("q3") + width).alias("fence_high"))
    marked = counted.join(fence, keys).withColumn("inside", x.between(F.col("fence_low"), F.col("fence_high")))
    inside = F.when(F.col("inside"), x)
    second = marked.groupBy(*keys, "n", "fence_low", "fence_high").agg(
        F.coalesce(F.sum(F.when(F.col("inside"), n)), F.lit(0)).alias("n_inside"), *[at(c, q).alias(name) for c, q, name in ((inside, 0.25, "in25"), (inside, 0.75, "in75"), (x, 0.25, "all25"), (x, 0.75, "all75"))]
    )
    few = F.col("n_inside") < least
    second = second.select(*keys, "n", "fence_low", "fence_high", few.alias("few"), F.when(few, F.col("n")).otherwise(F.col("n_inside")).alias("kept"), F.when(few, F.col("all25")).otherwise(F.col("in25")).alias("p25"), F.when(few, F.col("all75")).otherwise(F.col("in75")).alias("p75"))
    kept = counted.join(second, keys).where(F.col("few") | x.between(F.col("fence_low"), F.col("fence_high")))
    mean = lambda keep: F.sum(F.when(keep, x * n)) / F.sum(F.when(keep, n))
    middle = x.between(F.col("p25"), F.col("p75"))
    return kept.groupBy(*keys, "n", "kept", "fence_low", "fence_high", "p25", "p75").agg(F.coalesce(mean(middle), mean(F.lit(True))).alias("iqr_mean"))


def price_summary(prices: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Count, extremes, truncated median and mean, rounded quartiles, population deviation."""
    p = F.col(price)
    return prices.groupBy(*keys).agg(
        F.count(p).alias("sample_count"), F.min(p).alias("price_min"), F.floor(F.median(p)).cast("long").alias("price_median"), F.floor(F.avg(p)).cast("long").alias("price_mean"), F.max(p).alias("price_max"), F.round(F.stddev_pop(p), 2).alias("price_std"),
        *[F.bround(F.percentile(p, F.lit(q)), 0).cast("long").alias(name) for name, q in (("price_p25", 0.25), ("price_p75", 0.75))],
    )


def spread(references: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, deviation, n) of the minima, medians and maxima of price summaries."""
    each = references.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in ("price_min", "price_median", "price_max")])).alias("x"))
    return each.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.count(F.lit(1)).alias("n"))


def z_scores(ads: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Each ad's distance, in deviations, from the spread of its references' minima, medians and maxima."""
    return ads.join(spread(references, keys).where("n >= 3 and deviation > 0"), keys).withColumn("z", (F.col("price") - F.col("mean")) / F.col("deviation"))


def trend(rows: DataFrame, key: str, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Counts of the last days and of as many before, and the change in percent; null change where there were none before."""
    age = F.col(ts)
    last = (age > now - F.make_dt_interval(F.lit(days))) & (age <= now)
    before = (age > now - F.make_dt_interval(F.lit(2 * days))) & (age <= now - F.make_dt_interval(F.lit(days)))
    counts = rows.groupBy(key).agg(F.count_if(last).alias("recent"), F.count_if(before).alias("earlier"))
    return counts.withColumn("change", F.round(100.0 * (F.col("recent") - F.col("earlier")) / F.nullif("earlier", F.lit(0)), 1))


def status_pivot(rows: DataFrame, key: str, status: str, statuses: list[str]) -> DataFrame:
    """Counts by status as columns, zero where there are none, with their total."""
    wide = rows.groupBy(key).pivot(status, statuses).count().na.fill(0, statuses)
    return wide.withColumn("total", sum((F.col(s) for s in statuses), F.lit(0)))


def weighted_score(results: DataFrame, key: str) -> DataFrame:
    """Score of 0 to 100 from results (status, score, weight): neutral ones don't count, skipped ones count as 0; either
    kind makes it partial."""
    counts = F.col("status") != "neutral"
    total, gained = F.sum(F.when(counts, F.col("weight"))), F.sum(F.when(counts & (F.col("status") != "skip"), F.col("weight") * F.col("score")))
    # Sums of doubles end in noise that depends on their order. It must not decide which way a half is rounded.
    raw = F.round(F.coalesce(100 * F.coalesce(gained, F.lit(0.0)) / F.nullif(total, F.lit(0)), F.lit(0.0)), 9)
    out = results.groupBy(key).agg(raw.alias("raw"), F.max(F.col("status").isin("skip", "neutral")).alias("partial"))
    return out.select(key, F.bround(F.greatest(F.least("raw", F.lit(100.0)), F.lit(0.0)), 0).cast("long").alias("score"), F.col("partial").alias("is_partial"))


def weighted_score_of(results: list[Column], weights: list[float]) -> Column:
    """The same score as a struct (score, is_partial), of results within the row: plain sums, which stay in generated code;
    without results it is 0 and partial."""
    total, gained, partial = F.lit(0.0), F.lit(0.0), F.lit(not results)
    for r, weight in zip(results, weights, strict=True):
        neutral, skipped = r["status"] == "neutral", r["status"] == "skip"
        total = total + F.when(neutral, 0.0).otherwise(F.lit(float(weight)))
        gained = gained + F.when(neutral | skipped, 0.0).otherwise(r["score"] * float(weight))
        partial = partial | neutral | skipped
    raw = F.coalesce(gained / F.nullif(total, F.lit(0.0)), F.lit(0.0)) * 100
    return F.struct(F.bround(F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0)), 0).cast("long").alias("score"), partial.alias("is_partial"))


def unpivoted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of each column's values, long: (key, spec_type, spec_value, n)."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("spec_type"), F.lower(F.trim(F.col(c).cast("string"))).alias("spec_value")) for c in columns])).alias("x"))
    return long.select(key, "x.*").where("spec_value is not null").groupBy(key, "spec_type", "spec_value").agg(F.count(F.lit(1)).alias("n"))
