"""Queries over pages with embedded JSON. The pages are made from orders: the SQL never reads them, but the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import ads as ad_source
from ..sources import embedded
from .queries import query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their parts."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


LINES = """lines AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, p_brand AS make, p_type AS model, l_partkey AS part,
         CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(floor(l_quantity * 3000) AS BIGINT) AS km, CAST(year(l_shipdate) AS INT) AS year, l_suppkey AS seller, l_returnflag AS fuel
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _gathered(spark, sf_dir, one, *more) -> DataFrame:
    """(o, items): a struct for each line of an order, in their order."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", one.alias("item"))
    return _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["item"]).alias("items"), F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_brand", "p_type")).alias("first"), *more)


def _page(*scripts) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>x</title><script>var t = {a: 1}</script></head><body>"), *scripts, F.lit("</body></html>"))


def _script(text, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<script{attributes}>"), text, F.lit("</script>"))


def _price() -> Column:
    return F.floor("l_extendedprice").cast("long")


def _km() -> Column:
    return F.floor(F.col("l_quantity") * 3000).cast("long")


@query("WITH " + LINES + """, s AS (SELECT *, regexp_replace(lower(make), '[^a-z0-9-]', '', 'g') AS make_slug, lower(model) AS model_slug, first_value(make) OVER w AS m0, first_value(model) OVER w AS t0 FROM lines WINDOW w AS (PARTITION BY o ORDER BY place)),
u AS (SELECT *, CASE WHEN o % 5 > 0 THEN regexp_replace(lower(m0), '[^a-z0-9-]', '', 'g') || '-' || lower(t0) ELSE '' END AS slug FROM s),
x AS (SELECT *, CASE WHEN slug = '' THEN 0 ELSE CASE WHEN starts_with(slug, make_slug) THEN 2 ELSE 0 END + CASE WHEN make_slug = split_part(slug, '-', 1) THEN 1 ELSE 0 END + CASE WHEN contains(slug, model_slug) THEN 4 ELSE 0 END END AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY score DESC, place DESC) AS rn, count(*) OVER (PARTITION BY o) AS candidates FROM x)
SELECT o AS page_id, make, model, price, km AS mileage, CASE WHEN place % 2 = 0 THEN '2001-01-0' || (o % 9 + 1) || 'T00:00:00Z' END AS created, CAST(score AS INT) AS score, CASE WHEN o % 3 = 0 THEN 2 ELSE 1 END * candidates AS candidates FROM r WHERE rn = 1""")
def src_page_vehicle(spark, sf_dir):  # SRC12 UDTF UDF1
    # A vehicle stands some levels down, its make as text or as an object; the dates stand beside it, for every other one.
    vehicle = F.struct(F.col("p_brand").alias("make"), F.struct(F.col("p_type").alias("name")).alias("model"), _price().alias("price"), _km().alias("mileage"), F.lit('car "{x}').alias("vehicleCategory"))
    deep = F.struct(F.lit("}{").alias("note"), F.array(F.struct(F.struct(vehicle.alias("vehicle")).alias("listing"))).alias("props"), F.concat(F.lit("2001-01-0"), (F.col("l_orderkey") % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("created"))
    rows = _gathered(spark, sf_dir, deep)
    # Dates of odd places go: their key is another one.
    dated = F.transform("items", lambda x, i: F.replace(F.to_json(x), F.lit('"created"'), F.when(i % 2 == 0, '"createdDate"').otherwise('"other"')))
    text = F.array_join(dated, "; x = ")
    plain = F.replace(text, F.lit('\\"'), F.lit("'"))
    url = F.when(F.col("o") % 5 > 0, F.concat(F.lit("https://www.example.com/angebote/"), F.regexp_replace(F.lower("first.p_brand"), "[^a-z0-9-]", ""), F.lit("-"), F.lower("first.p_type"), F.lit("-"), F.lpad(F.col("o").cast("string"), 8, "0"))).otherwise("https://www.example.com/")
    # Every third order marks its script as a streamed one, which is decoded in two ways; both leave its quotes alone.
    body = F.when(F.col("o") % 3 == 0, F.concat(F.lit("/* self.__next_f */ "), plain)).otherwise(text)
    pages = rows.select(F.col("o").alias("page_id"), url.alias("url"), _page(_script(body)).alias("html"))
    found = embedded.page_vehicles(pages)
    return found.select("page_id", *[c.alias(k) for k, c in embedded.vehicle_fields(F.col("vehicle")).items()], F.col("score").cast("int").alias("score"), "candidates")


@query("WITH " + LINES + """, f AS (SELECT o, first_value(make) OVER (PARTITION BY o ORDER BY place) AS target, make, place, price, CASE WHEN km % 7 > 0 THEN km END AS km, CASE WHEN year % 3 > 0 THEN year END AS year, CASE fuel WHEN 'N' THEN NULL ELSE fuel END AS fuel, CASE WHEN seller % 4 > 0 THEN seller % 50 END AS hp, CASE WHEN part % 2 = 0 THEN 'p' || (part % 3) END AS uid FROM lines),
k AS (SELECT *, regexp_replace(lower(make), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(target), '[^a-z0-9]', '', 'g') AS b FROM f WHERE price > 500 AND price < 500000),
d AS (SELECT *, row_number() OVER (PARTITION BY o, coalesce(uid, price || '-' || coalesce(CAST(km AS VARCHAR), 'null')) ORDER BY place) AS rn FROM k WHERE contains(a, b) OR contains(b, a))
SELECT o AS page_id, CAST(place AS INT) AS place, uid, CAST(price AS INT) AS price, CAST(km AS INT) AS km, year, fuel, CASE WHEN place % 2 = 0 THEN 'Manual' END AS gearbox, CAST(hp AS INT) AS hp FROM d WHERE rn = 1""")
def src_data_listings(spark, sf_dir):  # SRC7 JSN3 STR18
    price = F.when(F.col("l_suppkey") % 2 == 0, _price().cast("string")).otherwise(F.concat(_price().cast("string"), F.lit(" EUR")))
    tracking = F.struct(price.alias("price"), F.when(_km() % 7 > 0, F.concat(_km().cast("string"), F.lit(" km"))).alias("mileage"), F.when(F.year("l_shipdate") % 3 > 0, F.concat(F.lit("03-"), F.year("l_shipdate").cast("string"))).otherwise("new").alias("firstRegistration"))
    details = F.array(F.struct(F.lit("Getriebe").alias("ariaLabel"), F.lit("gear").alias("iconName"), F.lit("x").alias("data")), F.struct(F.when(F.col("l_suppkey") % 8 < 4, "Leistung").otherwise("Power").alias("ariaLabel"), F.lit("speedometer").alias("iconName"), F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("77 kW ("), (F.col("l_suppkey") % 50).cast("string"), F.lit(" PS)"))).otherwise("77 kW").alias("data")))
    vehicle = F.struct(F.col("p_brand").alias("make"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("fuel"), F.lit("Manual").alias("transmission"))
    rows = _gathered(spark, sf_dir, F.struct(F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string"))).alias("id"), tracking.alias("tracking"), vehicle.alias("vehicle"), details.alias("vehicleDetails")))
    listings = F.transform("items", lambda x, i: x.withField("vehicle.transmission", F.when(i % 2 == 0, x["vehicle"]["transmission"])))
    data = F.to_json(F.struct(F.struct(F.struct(listings.alias("listings"), F.lit(1).alias("page")).alias("pageProps")).alias("props")))
    pages = rows.select(F.col("o").alias("page_id"), F.col("first.p_brand").alias("target_make"), _page(_script(data, ' id="__NEXT_DATA__" type="application/json" crossorigin')).alias("html"))
    return embedded.data_listings(pages).select("page_id", "place", "uid", "price", "km", "year", "fuel", "gearbox", "hp")


@query("WITH " + LINES + """, f AS (SELECT o, place, make, price, km, CASE WHEN year >= 1996 THEN year END AS year, fuel, CASE WHEN part % 3 = 0 THEN CAST(100000 + part % 4 AS VARCHAR) WHEN part % 3 = 1 THEN '/offer/' || part % 5 END AS uid, CASE WHEN seller % 3 > 0 THEN make END AS brand, first_value(make) OVER (PARTITION BY o ORDER BY place) AS target FROM lines),
k AS (SELECT *, regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(target), '[^a-z0-9]', '', 'g') AS b FROM f WHERE price > 500 AND price < 500000 AND o % 6 < 5),
d AS (SELECT *, row_number() OVER (PARTITION BY o, coalesce(uid, price || '-' || km) ORDER BY place) AS rn FROM k WHERE brand IS NULL OR contains(a, b) OR contains(b, a))
SELECT o AS page_id, CAST(place AS INT) AS place, uid, CAST(price AS INT) AS price, CAST(km AS INT) AS km, year, fuel FROM d WHERE rn = 1""")
def src_catalogue_listings(spark, sf_dir):  # SRC8
    odd = F.col("l_partkey") % 2 == 1
    url = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("https://x.example/a-"), (100000 + F.col("l_partkey") % 4).cast("string"), F.lit("?from=list"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("/offer/"), (F.col("l_partkey") % 5).cast("string")))
    q = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    value = lambda c: F.regexp_extract(q(c), r'(?s)^\{"v":(.*)\}$', 1)
    engine = F.concat(F.lit('{"fuelType":'), value(F.col("l_returnflag")), F.lit("}"))
    date = F.when(F.year("l_shipdate") >= 1996, F.date_format("l_shipdate", "yyyy-MM")).otherwise("12")
    car = F.concat(F.lit('{"vehicleEngine":'), F.when(odd, F.concat(F.lit("["), engine, F.lit("]"))).otherwise(engine), F.lit(',"mileageFromOdometer":'), F.when(odd, F.concat(F.lit('{"value":"'), _km().cast("string"), F.lit(' km"}'))).otherwise(_km().cast("string")), F.lit(',"'), F.when(odd, "vehicleModelDate").otherwise("productionDate"), F.lit('":'), value(date), F.lit(',"brand":{"name":'), value(F.when(F.col("l_suppkey") % 3 > 0, F.col("p_brand"))), F.lit("}"))
    # An item offers a car, or is one.
    item = F.when(odd, F.concat(F.lit('{"url":'), value(url), F.lit(',"offers":{"price":"'), _price().cast("string"), F.lit('.00","itemOffered":'), car, F.lit("}}}"))).otherwise(F.concat(car, F.lit(',"url":'), value(url), F.lit(',"price":'), _price().cast("string"), F.lit("}")))
    rows = _gathered(spark, sf_dir, item)
    # The last of six kinds lacks its end.
    catalogue = F.concat(F.lit('{"@type":"OfferCatalog","itemListElement":['), F.array_join("items", ","), F.lit("]}"))
    place = F.col("o") % 6
    data = (
        F.when(place == 0, catalogue).when(place == 1, F.concat(F.lit('{"mainEntity":{"offers":'), catalogue, F.lit("}}"))).when(place == 2, F.concat(F.lit('{"@type":"Page","offers":'), catalogue, F.lit("}")))
        .when(place == 3, F.concat(F.lit('{"@graph":[{"@type":"Thing"},{"offers":'), catalogue, F.lit("}]}"))).when(place == 4, F.concat(F.lit('{"@graph":[{"@graph":[{"@type":"WebSite"},'), catalogue, F.lit("]}]}"))).otherwise(F.substring(catalogue, 1, 40))
    )
    pages = rows.select(F.col("o").alias("page_id"), F.col("first.p_brand").alias("target_make"), _page(_script(F.lit("{broken"), " type='application/ld+json'"), _script(data, ' type="application/ld+json"')).alias("html"))
    found = embedded.catalogue_listings(pages)
    return found.select("page_id", (F.col("place") % 100_000).alias("place"), "uid", "price", "km", "year", "fuel")


@query("""WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 4 AS kind, o_orderkey, CAST(floor(o_totalprice) AS INT) AS total, o_orderpriority AS p FROM orders)
SELECT page_id, CASE WHEN kind < 3 THEN CAST(o_orderkey + 7 AS VARCHAR) END AS list_id, CASE WHEN kind < 3 THEN total END AS price, CASE WHEN kind < 3 THEN p END AS fuel, CASE WHEN kind < 3 THEN 'ad ' || o_orderkey END AS title FROM o""")
def src_ad_payload(spark, sf_dir):  # SRC5 JSN1 JSN3
    o = table(spark, sf_dir, "orders")
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    price = F.when(key % 2 == 0, F.concat(F.lit("["), F.floor("o_totalprice").cast("string"), F.lit(",1]"))).otherwise(F.floor("o_totalprice").cast("string"))
    ad = F.concat(F.lit('{"list_id":'), (key + 7).cast("string"), F.lit(',"subject":"ad '), key.cast("string"), F.lit('","price":'), price, F.lit(',"attributes":[{"key":"fuel","key_label":"Fuel","value":"9","value_label":"'), F.col("o_orderpriority"), F.lit('"}]}'))
    # At its path; elsewhere, after a list and a node that is none; as the whole payload; nowhere.
    data = (
        F.when(kind == 0, F.concat(F.lit('{"props":{"pageProps":{"ad":'), ad, F.lit("}}}"))).when(kind == 1, F.concat(F.lit('{"props":{"pageProps":{"ad":null,"data":[[{"attributes":[],"price":1}],{"deep":{"deeper":['), ad, F.lit("]}}]}}}")))
        .when(kind == 2, ad).otherwise('{"props":{"pageProps":{"ads":[{"list_id":1,"price":2}]}}}')
    )
    pages = o.select(key.alias("page_id"), _page(_script(data, ' id="__NEXT_DATA__" type="application/json"')).alias("html"))
    found = pages.withColumn("ad", embedded.ad_payload(embedded.next_data(F.col("html"))))
    attributes = F.try_variant_get("ad", "$.attributes", "array<struct<key: string, key_label: string, value: string, value_label: string>>")
    return found.select("page_id", F.try_variant_get("ad", "$.list_id", "string").alias("list_id"), ad_source.price_of(F.col("ad")).alias("price"), F.try_element_at(ad_source.attribute_map(attributes), F.lit("fuel")).alias("fuel"), F.try_variant_get("ad", "$.subject", "string").alias("title"))
