"""Coverage of vehicles: what is known of each, what is missing, and how ready it is.

Eight tables are brought to one shape (key, tag, three numbers, a text, a time) and summed by key in one pass: one shuffle
of partial sums instead of a join for each of them.

Defined cases: keys without a vehicle are ignored, null keys too; a vehicle that no table knows has all gaps; null numbers
and texts count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gaps from which a vehicle is critical or needs attention, and the number that readiness is taken of.
CRITICAL, ATTENTION, OUT_OF = 5, 2, 10
HOME = "FR"


def _shape(rows: DataFrame, tag: str, a=None, b=None, c=None, text=None, at=None) -> DataFrame:
    long = lambda x: (F.lit(None) if x is None else x).cast("long")
    return rows.select(F.col("key"), F.lit(tag).alias("tag"), long(a).alias("a"), long(b).alias("b"), long(c).alias("c"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if at is None else at).cast("timestamp_ntz").alias("at"))


def snapshot(vehicles: DataFrame, now: Column, specs: DataFrame, tires: DataFrame, market: DataFrame, seeds: DataFrame, videos: DataFrame, syntheses: DataFrame, scans: DataFrame) -> DataFrame:
    """One row for each of vehicles (key, has_tokens, has_slugs, least_samples), with counts, gaps and readiness.

    specs: key, fuel, hp; tires: key; market: key, country, sample_count, has_estimate, refresh_after; seeds: key; videos:
    key, transcript_chars (null without a transcript); syntheses: key; scans: key, source, created_at.
    """
    c = F.col
    # What a market row needs is the vehicle's own number, half of it (but five) abroad.
    least = F.when(F.coalesce(c("country"), F.lit(HOME)) == HOME, c("least_samples")).otherwise(F.greatest(F.floor(c("least_samples") / 2), F.lit(5)))
    needs = market.join(vehicles.select("key", "least_samples"), "key").withColumn("_least", least)
    parts = [
        _shape(specs, "spec", c("hp"), text=c("fuel")),
        _shape(tires, "tire"),
        _shape(needs, "market", c("sample_count"), c("sample_count") < c("_least"), c("has_estimate"), c("country"), c("refresh_after")),
        _shape(seeds, "seed"),
        _shape(videos, "video", c("transcript_chars")),
        _shape(syntheses, "synthesis"),
        _shape(scans, "scan", text=c("source"), at=c("created_at")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    tagged = lambda tag: c("tag") == tag
    n = lambda tag, kept=None: F.count_if(tagged(tag) & (F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))))
    fresh_within = lambda days: c("at") >= now - F.make_dt_interval(F.lit(days))
    summed = rows.where("key is not null").groupBy("key").agg(
        n("spec").alias("specs"), F.max(F.when(tagged("spec"), c("a"))).alias("max_hp"), F.array_sort(F.collect_set(F.when(tagged("spec"), c("text")))).alias("fuels"),
        n("tire").alias("tires"), n("market").alias("markets"), F.coalesce(F.sum(F.when(tagged("market"), c("a"))), F.lit(0)).alias("samples"), n("market", c("b") == 1).alias("insufficient"),
        n("market", c("c") == 1).alias("estimates"), n("market", F.coalesce(c("text"), F.lit(HOME)) != HOME).alias("abroad"), n("market", c("at") > now).alias("fresh"), n("seed").alias("seeds"),
        n("video", c("a").isNotNull()).alias("transcripts"), n("synthesis").alias("syntheses"),
        n("scan").alias("scans"), n("scan", fresh_within(7)).alias("scans_week"), n("scan", fresh_within(30)).alias("scans_month"), F.max(F.when(tagged("scan"), c("at"))).alias("last_scan"),
    )
    counts = [x for x in summed.columns if x not in ("key", "max_hp", "fuels", "last_scan")]
    found = vehicles.join(summed, "key", "left").na.fill(0, counts).withColumn("fuels", F.coalesce("fuels", F.array().cast("array<string>")))
    gaps = {
        "specs": c("specs") == 0,
        "tires": c("tires") == 0,
        "market": c("markets") == 0,
        "weak market": (c("markets") > 0) & (c("insufficient") == c("markets")),
        "seed": c("seeds") == 0,
        "estimate": c("estimates") == 0,
        "abroad": c("abroad") == 0,
        "videos": (c("transcripts") == 0) & (c("syntheses") == 0),
        "scans": c("scans") == 0,
        "tokens": ~F.coalesce(c("has_tokens"), F.lit(False)),
        "slugs": ~F.coalesce(c("has_slugs"), F.lit(False)),
    }
    found = found.withColumn("gaps", F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in gaps.items()])))
    many = F.size("gaps")
    status = F.when(~((c("markets") > 0) | (c("scans") > 0)) | (many >= CRITICAL), "critical").when(many >= ATTENTION, "attention").otherwise("healthy")
    return found.withColumns({"gap_count": many, "readiness": F.bround(100.0 * (OUT_OF - many) / OUT_OF, 0).cast("int"), "status": status})
