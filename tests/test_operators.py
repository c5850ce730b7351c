import pytest
from pyspark.sql import functions as F

from marketlens.functions import numbers, text
from marketlens.operators import catalogue, lookup, rules, sequences, stats
from marketlens.sources import ads
from marketlens.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: text.joined_int(F.lit("75 000 km")), 75000),
        (lambda: text.first_int(F.lit("75 000 km")), 75),
        (lambda: text.joined_int(F.lit("none")), None),
        (lambda: text.loose_int(F.lit(" 82.0 ")), 82),
        (lambda: text.loose_int(F.lit("x")), None),
        (lambda: text.compact_key(F.lit("Citroën C-Élysée")), "citroencelysee"),
        (lambda: text.title(F.lit("c-hr d'azur 5a")), "C-Hr D'Azur 5A"),
        (lambda: text.without_roman_suffix(F.lit("Golf VII")), "Golf"),
        (lambda: text.dial_country(F.lit("00 41 (0)79 123")), "CH"),
        (lambda: text.dial_country(F.lit("+352 12")), "LU"),
        (lambda: text.dial_country(F.lit("0612")), None),
        (lambda: text.caption_text(F.lit("WEBVTT\n\n1\n00:01 --> 00:02\n<c>hello</c>\nhello\nyou")), "hello you"),
        (lambda: text.country_of(F.lit("https://x.de/ad/voitures/1")), "DE"),
        (lambda: text.category_of(F.lit("https://x.fr/ad/voitures/1")), "voitures"),
        (lambda: text.alike(F.lit("VW"), F.lit(None).cast("string")), True),
        (lambda: numbers.to_eur(F.lit(35000.7), F.lit("eur")), 35000),
        (lambda: numbers.to_eur(F.lit(99.9), F.lit(None).cast("string")), 99),
        (lambda: numbers.to_eur(F.lit(1111.0), F.lit("chf")), 1044),
        (lambda: numbers.power_band(F.lit(75)), "min-90"),
        (lambda: numbers.power_band(F.lit(80)), "70-120"),
        (lambda: numbers.power_band(F.lit(300)), "240-360"),
        (lambda: numbers.power_band(F.lit(0)), None),
        (lambda: numbers.least_samples(F.lit(420)), 10),
        (lambda: numbers.least_samples(F.lit(421), small_market=F.lit(True)), 5),
        (lambda: numbers.least_samples(F.lit(100), small_market=F.lit(True)), 10),
        (lambda: text.slug(F.lit(" Citroën  C4 (2) ")), "citron-c4-2"),
        (lambda: numbers.to_eur(F.lit(100.0), F.lit("CHF")), 94),
        (lambda: numbers.to_eur(F.lit(100.0), F.lit("PLN")), 100),
        (lambda: numbers.uid_is_valid(F.lit("109322551")), True),
        (lambda: numbers.uid_is_valid(F.lit("109322552")), False),
        (lambda: numbers.stars(F.lit(3.5)), "★★★½☆"),
        (lambda: numbers.verdict(F.lit(59)), "doubtful"),
        (lambda: numbers.share(F.lit(1), F.lit(0)), None),
    ],
)
def test_functions(spark, column, expected):
    assert one(spark, column()) == expected


def prices(spark, values):
    return spark.createDataFrame([("a", v) for v in values], "k string, price long")


def test_outliers(spark):
    row = stats.outlier_free(prices(spark, [15000, 16000, 17000, 18000, 19000, 95000]), ["k"]).first()
    assert (row["n"], row["kept"]) == (6, 5)
    row = stats.outlier_free(prices(spark, [10000] * 5), ["k"]).first()
    assert (row["kept"], row["iqr_mean"]) == (5, 10000)
    row = stats.outlier_free(prices(spark, [500, 1000, 50000]), ["k"]).first()
    assert row["kept"] == 3


@pytest.mark.parametrize(
    ("results", "score", "partial"),
    [
        ([("pass", 1.0, 1.0), ("pass", 0.5, 1.0)], 75, False),
        ([("pass", 1.0, 1.0), ("skip", 0.0, 1.0)], 50, True),
        ([("neutral", 0.0, 1.0)], 0, True),
        ([("pass", 1.0, 1.0), ("neutral", 0.0, 2.0)], 100, True),
        ([("pass", 0.8, 1.5), ("warning", 0.5, 2.0)], 63, False),
        ([("fail", 0.0, 1.0)], 0, False),
    ],
)
def test_score(spark, results, score, partial):
    long = spark.createDataFrame([("a", *r) for r in results], "k string, status string, score double, weight double")
    row = stats.weighted_score(long, "k").first()
    assert (row["score"], row["is_partial"]) == (score, partial)
    each = [F.struct(F.lit(status).alias("status"), F.lit(x).alias("score")) for status, x, _ in results]
    within = one(spark, stats.weighted_score_of(each, [w for *_, w in results]))
    assert (within["score"], within["is_partial"]) == (score, partial)


def test_waterfall_tiers(spark):
    asks = spark.createDataFrame([(1, "m", 2020, "diesel"), (2, "m", 2020, "petrol"), (3, "m", 2017, "lpg"), (4, "m", 2000, None)], "ask long, make string, year int, fuel string")
    offers = spark.createDataFrame([("m", 2020, "Diesel", 1), ("m", 2020, None, 2), ("m", 2018, None, 3)], "make string, year int, fuel string, offer_id long")
    found = {r["ask"]: (r["tier"], r["offer_id"]) for r in lookup.waterfall(asks, offers, ["make"]).collect()}
    assert found == {1: (1, 1), 2: (2, 2), 3: (4, 3), 4: (None, None)}


def test_islands(spark):
    rows = spark.createDataFrame([("a", y) for y in (2023, 2024, 2024, 2026)], "k string, y int")
    assert sorted((r["first"], r["last"], r["n"]) for r in sequences.islands(rows, ["k"], "y").collect()) == [(2023, 2024, 2), (2026, 2026, 1)]


def test_mileage(spark):
    def found(km, year, price=12000, category="suv_compact", pro=False):
        row = one(spark, rules.mileage(F.lit(km), F.lit(year), F.lit(2026), F.lit(price), F.lit(category), F.lit(pro)))
        return row["status"], row["score"]

    assert found(150000, 2022) == ("warning", 0.5) and found(1, 2030) == ("fail", 0.0) and found(None, 2022) == ("skip", 0.0)
    assert found(60000, 2022) == ("pass", 1.0) and found(60000, 2022, 300) == ("warning", 0.5) and found(200000, 2022, 300) == ("fail", 0.2)
    assert found(2000, 2022, 60000, "sportive") == ("warning", 0.85) and found(120000, 2022, pro=True) == ("warning", 0.6)
    assert found(500, 2025) == ("warning", 0.65) and found(500, 2025, pro=True) == ("warning", 0.7)


def test_filters(spark):
    lit = F.lit
    none = lit(None).cast("string")

    def found(column):
        row = one(spark, column)
        return row["status"], row["score"]

    assert found(rules.listing_age(lit(30), lit(20000), republished=lit(True))) == ("pass", 0.8)
    assert found(rules.listing_age(lit(60), lit(20000), republished=lit(True))) == ("warning", 0.4)
    assert found(rules.listing_age(lit(90), lit(20000), republished=lit(True))) == ("fail", 0.2)
    assert found(rules.listing_age(lit(90), lit(20000), median_days=lit(300))) == ("pass", 1.0)
    seller = lambda owner, number, country="FR", state="A", rating=None: found(rules.registered(lit(owner), lit(number), lit(country), lit(False), lit(rating), lit(30), None if state is False else lit(state)))
    assert seller("private", None) == ("neutral", 0.0) and seller("pro", None) == ("warning", 0.3) and seller("pro", None, rating=4.5) == ("pass", 0.7)
    assert seller("pro", "123") == ("fail", 0.1) and seller("pro", "123456789") == ("pass", 0.9) and seller("pro", "123456789", state="C") == ("warning", 0.4)
    assert seller("pro", "123456789", state=False) == ("skip", 0.0) and seller("pro", "CHE-109.322.551", "CH", False) == ("pass", 0.7)
    assert found(rules.imported([lit(True)], [lit(True), lit(None).cast("boolean")])) == ("warning", 0.4)
    assert found(rules.presentation(none, lit("private"), lit(0), [lit(False)], none, none, none)) == ("fail", 0.0)
    assert found(rules.presentation(lit("x" * 60), none, lit(2), [lit(False)], none, none, lit("69"))) == ("pass", 0.5)


def test_payloads(spark):
    f = lambda s: F.parse_json(F.lit(s))
    assert one(spark, ads.price_of(f('{"price": [18500]}'))) == 18500
    assert one(spark, ads.price_of(f('{"price": 5000}'))) == 5000
    assert one(spark, ads.price_of(ads.ad_of(f('{"props": {"pageProps": {"ad": {"price": 7}}}}')))) == 7
    listed = one(spark, ads.listed_prices(F.lit('{"price":12000,"x":1,"mileage":5},{"price":100,"mileage":7}')))
    assert [(r["price"], r["km"]) for r in listed] == [(12000, 5)]


def test_attributes(spark):
    kind = "array<struct<key:string,key_label:string,value:string,value_label:string>>"
    row = spark.createDataFrame([([("brand", "Make", "p", "Peugeot"), ("brand", None, "x", ""), (None, "Make", "z", None)],)], f"a {kind}").select(ads.attribute_map(F.col("a")).alias("m")).first()
    assert row["m"] == {"brand": "x", "Make": "Peugeot"}


def test_specs_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Make,hp,Extra\n Audi ,82.0,1\nBMW,x,2\n")
    rows = ads.read_specs(spark, str(tmp_path / "s.csv"), ["hp"], ["Make"], {"Make": "make"}).collect()
    assert sorted((r["make"], r["hp"]) for r in rows) == [("Audi", 82), ("BMW", None)]


def test_streaming_upsert_and_counts(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = jobs.upserting(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["user_id"], "ts")
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(str(tmp_path / "t/version=2"))
    assert last.count() == events.select("user_id").distinct().count()
    assert last.agg(F.max("ts")).first()[0] == events.agg(F.max("ts")).first()[0]
    q = jobs.daily_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("count")).first()[0] == events.count()


def test_rows_are_counted_before_they_meet_vehicles(spark):
    rows = spark.createDataFrame([(1, "A", "x", 3), (None, "a", "X", 5), (None, "A", "x", 2), (9, "A", "x", 1), (None, None, "x", 4), (None, "B", "y", 7)], "vehicle_id int, make string, model string, n int")
    vehicles = spark.createDataFrame([(1, "A", "X"), (2, "a", "x"), (3, "C", "z")], "vehicle_id int, make string, model string")
    found = catalogue.counted_either(rows, vehicles, "n")
    assert {r["vehicle"]: r["n"] for r in found.collect()} == {1: 10, 2: 7}
    each = rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n"))))
    slow = catalogue.matched_either(each, vehicles, "_").groupBy("vehicle").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(slow.collect()) == sorted(found.collect())


def test_nearest_reads_no_frame_to_the_end(spark):
    rows, others = spark.createDataFrame([(i, 1, float(i)) for i in range(20)], "r int, k int, x double"), spark.createDataFrame([(i, 1, 3.0 * i) for i in range(4)], "o int, k int, y double")
    found = lookup.nearest(rows, others, ["k"], "r", "x", "y", "o")
    assert {x["r"]: x["o"] for x in found.collect()} == {i: min(range(4), key=lambda o: (abs(3 * o - i), o)) for i in range(20)}
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_a_score_of_a_half_is_rounded_to_even(spark):
    rows = [(1, "pass", 1.0, 1.0)] * 11 + [(1, "pass", 0.5, 1.0)] + [(1, "skip", 0.0, 1.0)] * 8  # 11.5 of 20 are 57.5
    assert stats.weighted_score(spark.createDataFrame(rows, "k int, status string, score double, weight double"), "k").collect()[0]["score"] == 58
    # 0.1 + 0.2 + 0.075 are 0.375 of 5 in any order, 7.5 percent.
    for order in ((0.1, 0.2, 0.075), (0.2, 0.075, 0.1), (0.075, 0.1, 0.2)):
        some = [(1, "pass", x, 1.0) for x in order] + [(1, "skip", 0.0, 2.0)]
        assert stats.weighted_score(spark.createDataFrame(some, "k int, status string, score double, weight double").coalesce(1), "k").collect()[0]["score"] == 8


def test_ads_meet_prices_of_their_kind_in_one_join(spark):
    from marketlens.plans import prices

    ads = spark.createDataFrame([("a", "Kia", "Rio", None, "EUROPE", "R", 100, 5, 1)], "ad_id string, make string, model string, year int, region string, fuel string, price long, hp int, seller long")
    found = prices.price_filter(ads)
    assert found.select("ad_id", "reference.market_result").collect() == [("a", "not_found")]
    plan, joins = found._jdf.queryExecution().optimizedPlan(), 0
    while plan.children().nonEmpty():
        joins += plan.nodeName() == "Join"
        plan = plan.children().apply(0)
    assert joins == 1
