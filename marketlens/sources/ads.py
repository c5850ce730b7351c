"""Semi-structured ads: attribute lists, polymorphic prices, embedded listings, HTML fields, and typed CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import loose_int


def attribute_map(attributes: Column) -> Column:
    """Map of an attribute list (struct key, key_label, value, value_label): labels first-wins, keys last-wins."""
    value = lambda a: F.coalesce(F.nullif(a["value_label"], F.lit("")), F.nullif(a["value"], F.lit("")))
    named = lambda k: F.filter(F.transform(attributes, lambda a: F.struct(a[k].alias("key"), value(a).alias("value"))), lambda e: e["key"].isNotNull())
    first = F.reverse(named("key_label"))
    return F.map_from_entries(F.concat(first, named("key")))


def price_of(payload: Column) -> Column:
    """A price that is a number or a list of numbers, from a variant."""
    return F.coalesce(F.try_variant_get(payload, "$.price", "int"), F.try_variant_get(payload, "$.price[0]", "int"))


def ad_of(payload: Column) -> Column:
    """The ad of a page's variant: at its usual path, else the payload itself if it looks like an ad."""
    usual = F.try_variant_get(payload, "$.props.pageProps.ad", "variant")
    return F.coalesce(usual, F.when(F.try_variant_get(payload, "$.attributes", "variant").isNotNull(), payload))


def listed_prices(text: Column, low: int = 500, high: int = 500_000) -> Column:
    """Prices and mileages of a search result's inline data, in order; prices outside (low, high) go."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(r'"price":(\d+)[^{}]*?"mileage":(\d+)'), 1).alias("price"), F.regexp_extract_all(text, F.lit(r'"price":(\d+)[^{}]*?"mileage":(\d+)'), 2).alias("km"))
    typed = F.transform(pairs, lambda p: F.struct(p["price"].try_cast("int").alias("price"), p["km"].try_cast("int").alias("km")))
    return F.filter(typed, lambda p: (p["price"] > low) & (p["price"] < high))


def first_found(*arrays: Column) -> Column:
    """The first array that is not empty."""
    out = F.array().cast("array<struct<price:int,km:int>>")
    for a in reversed(arrays):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def html_fields(html: Column) -> dict[str, Column]:
    """Title, language, number of links and paragraphs of a page."""
    return {
        "page_title": F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)),
        "page_lang": F.regexp_extract(html, r'<html lang="([a-z]+)"', 1),
        "n_links": F.regexp_count(html, F.lit(r'<a href="')).cast("long"),
        "n_paragraphs": F.regexp_count(html, F.lit("<p>")).cast("long"),
    }


def read_specs(spark: SparkSession, path: str, ints: list[str], texts: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """A CSV with header, columns found by name; whole numbers are parsed leniently ("82.0" is 82, garbage is null)."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = renamed or {}
    return rows.select(*[F.trim(c).alias(names.get(c, c)) for c in texts], *[loose_int(F.col(c)).alias(names.get(c, c)) for c in ints])


def quarantine(rows: DataFrame, **rules: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with the names of the rules they break (a null answer breaks a rule)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)
