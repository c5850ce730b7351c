"""Queries for reference prices: ranked offers with power ranges, and the cascade of sources behind the price filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import cascade
from ..session import new_path, settled
from .queries import query
from .roles import ADS, settled_ads

KEYS = ["make", "model", "region"]
MARKET = ["sample_count", "price_iqr_mean", "price_median"]
BAND = "CASE WHEN hp * 8 < 80 THEN 'min-90' WHEN hp * 8 < 110 THEN '70-120' WHEN hp * 8 < 140 THEN '100-150' WHEN hp * 8 < 180 THEN '130-190' WHEN hp * 8 < 250 THEN '170-260' WHEN hp * 8 < 350 THEN '240-360' ELSE '340-max' END"
OFFERS = """offers AS (
  SELECT make, model, region, year, nullif(fuel, 'N') AS fuel, hp_range, concat_ws('|', year, fuel, coalesce(hp_range, 'any')) AS offer_id, count(*) AS sample_count,
         CASE WHEN count(*) % 2 = 1 THEN CAST(floor(avg(price)) AS BIGINT) ELSE 0 END AS price_iqr_mean, CAST(floor(median(price)) AS BIGINT) AS price_median
  FROM (SELECT make, model, region, year - year % 2 AS year, fuel, price, CASE WHEN seller % 2 = 0 THEN """ + BAND + """ END AS hp_range FROM ads) GROUP BY ALL),
asked AS (SELECT *, row_number() OVER () AS row, """ + BAND + """ AS band, CASE WHEN seller % 5 > 0 THEN fuel END AS want FROM ads),
ranked AS (
  SELECT a.row, o.*, abs(o.year - a.year) AS gap,
         CASE WHEN o.year = a.year AND o.fuel = a.want THEN 1 WHEN o.year = a.year AND (o.fuel IS NULL OR a.want IS NULL) THEN 2 WHEN abs(o.year - a.year) <= 3 AND o.fuel = a.want THEN 3 WHEN abs(o.year - a.year) <= 3 AND (o.fuel IS NULL OR a.want IS NULL) THEN 4 END AS tier, {power} AS power_tier
  FROM asked a JOIN offers o ON a.make = o.make AND a.model = o.model AND a.region = o.region),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY tier, power_tier, gap, offer_id) AS rn FROM ranked WHERE tier IS NOT NULL) WHERE rn = 1)"""


def _powered(a):
    return a.withColumn("hp_range", F.when(F.col("seller") % 2 == 0, numbers.power_band(F.col("hp") * 8)))


def _offers(rows, n=None):
    """Offers of rows with hp_range, each of which stands for n ads."""
    rows = rows.select(*KEYS, (F.col("year") - F.col("year") % 2).alias("year"), "fuel", "price", "hp_range", (F.lit(1) if n is None else n).alias("n"))
    n, price = F.sum("n"), F.col("price")
    out = rows.groupBy(*KEYS, "year", "fuel", "hp_range").agg(n.alias("sample_count"), F.when(n % 2 == 1, F.floor(_mean(price))).otherwise(0).cast("long").alias("price_iqr_mean"), F.floor(F.percentile(price, F.lit(0.5), F.col("n"))).cast("long").alias("price_median"))
    return out.withColumns({"offer_id": F.concat_ws("|", "year", "fuel", F.coalesce("hp_range", F.lit("any"))), "fuel": F.when(F.col("fuel") != "N", F.col("fuel"))})


def _mean(x):
    """Mean of values that each stand for n."""
    return F.sum(x * F.col("n")) / F.sum(F.when(x.isNotNull(), F.col("n")))


def sold(a):
    """Ads counted by price and by all else that lookups of prices depend on: (make, model, region, year, fuel, want,
    band, hp_range, price, n). What the lookups read is this one settled table, not the ads."""
    kinds = _powered(_asked(a)).select(*KEYS, "year", F.col("asked_fuel").alias("fuel"), F.col("fuel").alias("want"), "band", "hp_range", "price")
    return settled(kinds.groupBy(*kinds.columns).agg(F.count(F.lit(1)).alias("n")), new_path(a.sparkSession, "sold"))


def _asked(a):
    return a.withColumns({"asked_fuel": F.col("fuel"), "fuel": F.when(F.col("seller") % 5 > 0, F.col("fuel")), "band": numbers.power_band(F.col("hp") * 8)})


@query("WITH " + ADS + ", " + OFFERS.format(power="CASE WHEN o.hp_range = a.band THEN 1 WHEN o.hp_range IS NULL THEN 2 ELSE 3 END") + " SELECT a.ad_id, a.year, b.tier, b.power_tier, b.offer_id FROM asked a LEFT JOIN best b ON a.row = b.row")
def join_ranked_offer(spark, sf_dir):  # JN13
    a = settled_ads(spark, sf_dir, "ad_id", *KEYS, "year", "fuel", "price", "hp", "seller")
    # Prices of offers are not shown, so they are not summed up either.
    asked, offers = _asked(a), _offers(_powered(a)).drop("sample_count", "price_iqr_mean", "price_median")
    kinds = settled(cascade.best_of_kinds(asked, offers, KEYS, "band").withColumn("offer", F.col("offer.offer_id")), new_path(spark, "kinds"))
    return cascade.with_kinds(asked, kinds, KEYS, ["year", "fuel", "band"]).select("ad_id", "year", "tier", "power_tier", F.col("offer").alias("offer_id"))


CASCADE = OFFERS.format(power="CASE WHEN o.hp_range IS NULL THEN 2 ELSE 3 END") + """, seeds AS (SELECT make, model, region, year, CASE WHEN count(*) % 3 = 0 THEN CAST(floor(avg(price)) AS BIGINT) END AS mid FROM ads GROUP BY make, model, region, year),
facts AS (
  SELECT a.*, b.sample_count, coalesce(b.sample_count >= CASE WHEN a.hp * 10 > 420 THEN 2 ELSE 3 END, false) AS enough, coalesce(nullif(b.price_iqr_mean, 0), nullif(b.price_median, 0)) AS market, nullif(s.mid, 0) AS seed,
         CASE WHEN seller % 3 = 0 THEN (floor(a.price * 0.8::DOUBLE) + floor(a.price * 1.5::DOUBLE)) / 2 END AS estimate, CASE WHEN seller % 4 = 0 THEN a.price * 1.7::DOUBLE END AS quotation
  FROM asked a LEFT JOIN best b ON a.row = b.row LEFT JOIN seeds s ON a.make = s.make AND a.model = s.model AND a.region = s.region AND a.year = s.year),
sourced AS (
  SELECT *, CASE WHEN enough AND market IS NOT NULL THEN 0 WHEN seed IS NOT NULL THEN 1 WHEN estimate IS NOT NULL THEN 2 WHEN quotation IS NOT NULL THEN 3 ELSE 4 END AS place, CASE WHEN enough THEN 'found' WHEN sample_count > 0 THEN 'insufficient' ELSE 'not_found' END AS market_result FROM facts),
priced AS (
  SELECT *, CASE place WHEN 0 THEN CASE WHEN region = 'EUROPE' THEN 'market_home' ELSE 'market_abroad' END WHEN 1 THEN 'argus_seed' WHEN 2 THEN 'estimate' WHEN 3 THEN 'quotation' END AS source, CASE place WHEN 0 THEN market WHEN 1 THEN seed WHEN 2 THEN estimate WHEN 3 THEN quotation END::DOUBLE AS ref FROM sourced),
gaps AS (SELECT *, 100.0::DOUBLE * (price - ref) / ref * CASE WHEN place IN (2, 3) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS gap FROM priced),
l4 AS (
  SELECT row, ad_id, region, source, least(place + 1, 4) AS tried, market_result, CASE WHEN ref IS NULL OR seller % 13 = 0 THEN 'skip' WHEN abs(gap) <= 10 THEN 'pass' WHEN abs(gap) <= 25 THEN 'warning' ELSE 'fail' END AS status,
         CASE WHEN ref IS NULL OR seller % 13 = 0 THEN 0.0 WHEN abs(gap) <= 10 THEN 1.0 WHEN abs(gap) <= 25 THEN 0.5 ELSE 0.1 END::DOUBLE AS score, coalesce(hp * 2 > 30 AND gap < -10, false) AS stale FROM gaps)"""


def with_offers(a, counted, lookups=lambda kinds: kinds):
    """Ads (with asked_fuel) and their offer and seed; counted is sold(a). lookups may add columns to the kinds of ads
    (make, model, region, year, fuel), which the ads then get in the same join."""
    c = F.col
    seeds = counted.groupBy(*KEYS, "year").agg(F.when(F.sum("n") % 3 == 0, F.floor(_mean(c("price"))).cast("long")).alias("seed"))
    best = cascade.best_of_kinds(counted.withColumn("fuel", c("want")), _offers(counted, c("n")), KEYS)
    # Of an offer the kinds keep what a reference reads, so that they stay small enough to be broadcast.
    best = best.select(*KEYS, "year", "fuel", *[c(f"offer.{x}").alias(x) for x in MARKET])
    kinds = settled(lookups(best.join(seeds, [*KEYS, "year"], "left")), new_path(a.sparkSession, "kinds"))
    return cascade.with_kinds(_asked(a), kinds, KEYS, ["year", "fuel"])


def judged():
    """(reference, l4, stale_below) of with_offers's rows."""
    c = F.col
    guess = lambda share: F.when(c("seller") % 3 == 0, F.floor(c("price") * share))
    name = F.when(c("region") == "EUROPE", "market_home").otherwise("market_abroad")
    reference = cascade.reference(F.struct(*MARKET), c("seed"), guess(0.8), guess(1.5), F.when(c("seller") % 4 == 0, c("price") * 1.7), c("hp") * 10, name)
    shown = F.when(F.coalesce(c("seller") % 13 != 0, F.lit(True)), c("region"))  # some ads name no region
    return reference, cascade.against_reference(c("price"), reference, [c("make"), c("model"), c("year"), shown]), cascade.stale(c("price"), reference, c("hp") * 2)


def price_filter(a):
    """Ads (with asked_fuel) and the columns reference, l4 and stale_below."""
    return with_offers(a, sold(a)).withColumns(dict(zip(("reference", "l4", "stale_below"), judged(), strict=True)))


@query("WITH " + ADS + ", " + CASCADE + " SELECT source, market_result, tried, status, stale, count(*) AS n, round(avg(score), 3) AS score FROM l4 GROUP BY source, market_result, tried, status, stale")
def rule_price(spark, sf_dir):  # L4 JN14
    a = settled_ads(spark, sf_dir, *KEYS, "year", "fuel", "price", "hp", "seller")
    found = price_filter(a)
    return found.groupBy(F.col("reference.source").alias("source"), F.col("reference.market_result").alias("market_result"), F.size("reference.tried").alias("tried"), F.col("l4.status").alias("status"), F.col("stale_below").alias("stale")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l4.score"), 3).alias("score"))
