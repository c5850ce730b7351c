"""Joins and lookups: waterfalls of ranked conditions, ranges, nearest values, positions, best matches and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cascade import with_best_offer


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in order; end the order with something unique."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def waterfall(asks: DataFrame, offers: DataFrame, keys: list[str], years: int = 3) -> DataFrame:
    """Each ask (year, fuel) with tier, gap and the columns of the best offer (year, fuel, offer_id, ...) of its keys.

    See cascade.best_offer for the tiers; asks without an offer stay, with nulls.
    """
    found = with_best_offer(asks, offers, keys, years=years)
    more = [c for c in offers.columns if c not in {*keys, "year", "fuel"}]
    return found.select(*asks.columns, "tier", "gap", F.col("offer.year").alias("o_year"), F.col("offer.fuel").alias("o_fuel"), *[F.col(f"offer.{c}").alias(c) for c in more])


def range_join(rows: DataFrame, ranges: DataFrame, keys: list[str], value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Equi-join on keys with value inside [low, high]; a null bound is open."""
    inside = (F.col(low).isNull() | (F.col(low) <= F.col(value))) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))
    return rows.join(ranges, keys).where(inside)


def nearest(rows: DataFrame, others: DataFrame, keys: list[str], row_id: str, at: str, other_at: str, other_id: str) -> DataFrame:
    """Each row with the nearest of the others' values within its keys, ties to the smaller id.

    Both sides are sorted together by value; the last of the others up to a row and the first from it on are its only
    candidates, so no pairs are made.
    """
    own = [c for c in others.columns if c not in keys]
    least = others.groupBy(*keys, other_at).agg(F.min(F.struct(F.col(other_id).alias("_id"), *[F.col(c).alias(c) for c in own])).alias("_o"))
    both = rows.select(*keys, F.col(at).alias("_at"), F.struct(*rows.columns).alias("_r"), F.lit(None).cast(least.schema["_o"].dataType).alias("_o"))
    both = both.unionByName(least.select(*keys, F.col(other_at).alias("_at"), F.lit(None).cast(both.schema["_r"].dataType).alias("_r"), "_o"))
    order = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # From the other end: a frame that runs to the end is read anew for each row, one from the beginning is not.
    after = Window.partitionBy(*keys).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({"_low": F.last("_o", ignorenulls=True).over(order), "_high": F.last("_o", ignorenulls=True).over(after)}).where("_r is not null")
    near = F.array_min(F.filter(F.array(*[F.struct(F.abs(F.col("_at") - F.col(f"{x}.{other_at}")).alias("distance"), F.col(f"{x}._id").alias("_id"), F.col(x).alias("_o")) for x in ("_low", "_high")]), lambda s: s["_o"].isNotNull()))
    return found.withColumn("_best", near).where("_best is not null").select("_r.*", *[F.col(f"_best._o.{c}").alias(c) for c in own if c not in rows.columns], F.col("_best.distance").alias("distance"))


def attach_in_order(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """The n-th left row of a key meets the n-th right row of it; left rows beyond stay, with nulls."""
    numbered = lambda d, by: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return numbered(left, left_id).join(numbered(right, right_id), [*keys, "_n"], "left").drop("_n")


def best_containing(rows: DataFrame, patterns: DataFrame, row_id: str, text: str) -> DataFrame:
    """Each row with the pattern (pattern, score, pattern_id) of best score that its text contains; patterns are a small
    dimension, joined by containment."""
    found = rows.join(patterns, F.contains(F.lower(text), F.lower("pattern")))
    return first_by(found, [row_id], F.desc("score"), F.col("pattern_id"))


def resolved(rows: DataFrame, aliases: DataFrame, key: Column, name: str) -> DataFrame:
    """Column name: the alias table's (alias, canonical) answer for key, else the key itself."""
    return rows.withColumn("_key", key).join(aliases.select(F.col("alias").alias("_key"), "canonical"), "_key", "left").withColumn(name, F.coalesce("canonical", "_key")).drop("_key", "canonical")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *latest: Column) -> DataFrame:
    """Old and new rows, the first by latest for each key; null keys are keys like others."""
    return first_by(old.unionByName(new), keys, *latest)


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows whose keys the right side lacks (null keys match null keys)."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, same, "left_anti")


def presence(base: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """A boolean column for each of others: whether it has the key. One pass over tagged keys instead of a join each."""
    tagged = None
    for name, frame in others.items():
        part = frame.select(F.col(key), F.lit(name).alias("_tag"))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy(key).agg(*[F.max((F.col("_tag") == name)).alias(name) for name in others])
    return base.join(flags, key, "left").na.fill(False, list(others))
