"""Reference prices: the best offer of ranked tiers, and the cascade of sources behind a price filter.

Offers are gathered once into one array for each coarse key (a handful of years, fuels and power ranges, one offer for
each of them). The best one is found within the row, without a window, for each distinct kind of ask, not for each ad.

Defined cases: a null in a key matches nothing; an ad without any offer has a null reference; an offer without fuel or
power range is a general one; ties go to the smaller offer_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import result

# Samples that a market price needs, and those of a rare vehicle (above so much power); days after which a
# cheap ad is stale.
LEAST_SAMPLES, LEAST_OF_RARE, RARE_HP, STALE_DAYS = 3, 2, 420, 30


def gathered(offers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _offers): all offers (year, fuel, offer_id, hp_range where known, ...) of a key."""
    return offers.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in offers.columns if c not in keys])).alias("_offers"))


def best_offer(offers: Column, year: Column, fuel: Column, hp_range: Column | None = None, years: int = 3, with_power: bool = True) -> Column:
    """The offer of the first tier that has one: (tier, power_tier, gap, offer).

    Tiers: same year and fuel; same year without fuel; within years, same fuel; within years, without fuel. An ask without
    fuel takes any fuel. Inside of a tier offers of the asked power range come first, then those without one, then any;
    then nearer years, then smaller ids.
    """

    def ranked(o: Column) -> Column:
        gap = F.abs(o["year"] - year)
        same, loose = F.coalesce(F.lower(o["fuel"]) == F.lower(fuel), F.lit(False)), o["fuel"].isNull() | fuel.isNull()
        tier = F.when((gap == 0) & same, 1).when((gap == 0) & loose, 2).when((gap <= years) & same, 3).when((gap <= years) & loose, 4)
        power = F.lit(1)
        if with_power:
            asked = F.lit(False) if hp_range is None else F.coalesce(F.lower(F.trim(o["hp_range"])) == F.lower(F.trim(hp_range)), F.lit(False))
            power = F.when(asked, 1).when(o["hp_range"].isNull(), 2).otherwise(3)
        return F.struct(tier.alias("tier"), power.alias("power_tier"), gap.alias("gap"), o["offer_id"].alias("offer_id"), o.alias("offer"))

    return F.array_min(F.filter(F.transform(offers, ranked), lambda r: r["tier"].isNotNull()))


def best_of_kinds(asks: DataFrame, offers: DataFrame, keys: list[str], hp_range: str | None = None, years: int = 3) -> DataFrame:
    """The distinct (keys, year, fuel, power) of asks with tier, power_tier, gap and the struct offer, all null where no
    offer is found."""
    loose = ["year", "fuel", *([hp_range] if hp_range else [])]
    kinds = asks.select(*keys, *loose).distinct()
    best = best_offer(F.col("_offers"), F.col("year"), F.col("fuel"), F.col(hp_range) if hp_range else None, years, "hp_range" in offers.columns)
    return kinds.join(gathered(offers, keys), keys, "left").withColumn("_best", best).select(*keys, *loose, *[F.col(f"_best.{c}").alias(c) for c in ("tier", "power_tier", "gap", "offer")])


def with_kinds(asks: DataFrame, kinds: DataFrame, keys: list[str], loose: list[str]) -> DataFrame:
    """asks with the other columns of kinds, a row for each distinct (keys, loose); a null in loose is a value like others.

    What depends on the kind of an ask alone is best joined to the kinds: the asks are shuffled once, however many lookups
    there are.
    """
    added = [c for c in kinds.columns if c not in {*keys, *loose}]
    found = kinds.select(*[F.col(c).alias(f"_{c}") for c in [*keys, *loose]], *added)
    on = [F.col(c) == F.col(f"_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in loose]
    return asks.join(found, on, "left").select(*asks.columns, *added)


def with_best_offer(asks: DataFrame, offers: DataFrame, keys: list[str], hp_range: str | None = None, years: int = 3) -> DataFrame:
    """asks (keys, year, fuel) with tier, power_tier, gap and the struct offer, all null where no offer is found.

    Asks of one kind have one answer: it is worked out for each distinct (keys, year, fuel, power) and joined back.
    """
    return with_kinds(asks, best_of_kinds(asks, offers, keys, hp_range, years), keys, ["year", "fuel", *([hp_range] if hp_range else [])])


def reference(market: Column, seed: Column, low: Column, high: Column, quotation: Column, hp: Column, market_name: Column) -> Column:
    """The first source that has a price: (source, price, halved, tried, market_result).

    market has sample_count, price_iqr_mean and price_median and counts with enough samples alone; then a seed price, the
    middle of an estimate, and a quotation; the last two are less certain, and their distances are halved.
    """
    filled = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    enough = F.coalesce(market["sample_count"] >= F.when(hp > RARE_HP, LEAST_OF_RARE).otherwise(LEAST_SAMPLES), F.lit(False))
    prices = {
        "market_price": F.when(enough, F.coalesce(filled(market["price_iqr_mean"]), filled(market["price_median"]))),
        "argus_seed": filled(seed),
        "estimate": (filled(low) + filled(high)) / 2,
        "quotation": F.when(quotation > 0, quotation.cast("double")),
    }
    names = list(prices)
    at = F.coalesce(*[F.when(p.isNotNull(), F.lit(i)) for i, p in enumerate(prices.values())], F.lit(len(names)))
    source = F.get(F.array(market_name, *[F.lit(x) for x in names[1:]]), at)
    state = F.when(enough, "found").when(market["sample_count"] > 0, "insufficient").otherwise("not_found")
    return F.struct(source.alias("source"), F.coalesce(*prices.values()).alias("price"), at.isin(2, 3).alias("halved"), F.slice(F.array(*map(F.lit, names)), F.lit(1), F.least(at + 1, F.lit(len(names)))).alias("tried"), state.alias("market_result"))


def distance(price: Column, ref: Column) -> Column:
    """Distance from a reference in percent, halved where the reference says so; null without price or reference."""
    return 100.0 * (price - ref["price"]) / ref["price"] * F.when(ref["halved"], 0.5).otherwise(1.0)


def against_reference(price: Column, ref: Column, needed: list[Column]) -> Column:
    """Up to 10 percent passes, up to 25 warns, more fails; without price, reference or a needed value nothing is said."""
    missing = price.isNull() | ref["price"].isNull()
    for c in needed:
        missing = missing | c.isNull()
    gap = F.abs(distance(price, ref))
    status = F.when(missing, "skip").when(gap <= 10, "pass").when(gap <= 25, "warning").otherwise("fail")
    score = F.when(missing, 0.0).when(gap <= 10, 1.0).when(gap <= 25, 0.5).otherwise(0.1)
    return result(status, score, F.round(distance(price, ref), 1))


def stale(price: Column, ref: Column, days_online: Column) -> Column:
    """Cheap for more than ten percent, and still not sold after STALE_DAYS."""
    return F.coalesce((days_online > STALE_DAYS) & (distance(price, ref) < -10), F.lit(False))
