"""Ladders of searches and cascades of reference prices, on small tables whose answers are known."""

import random

from pyspark.sql import functions as F

from marketlens.operators import cascade, ladders

TARGET = "target_id int, make string, model string, year int, fuel string, gearbox string, hp int, km int, region string, lat double, lng double, second_make string, has_gearbox boolean, is_hybrid boolean"
AD = "make string, model string, title string, year int, fuel string, gearbox string, hp int, km int, region string, lat double, lng double, price int"


def target(i, make="DS", model="3", year=2000, fuel="petrol", region="north", lat=45.0, second="CITROEN", gearbox="manual"):
    return (i, make, model, year, fuel, gearbox, 100, 50000, region, lat, 5.0, second, gearbox is not None, False)


def ad(price, make="DS", model="3", title="", year=2000, fuel="petrol", gearbox="manual", hp=100, km=50000, region="north", lat=45.0):
    return (make, model, title, year, fuel, gearbox, hp, km, region, lat, 5.0, price)


def climbed(spark, targets, ads, ladder=ladders.FIRST_SITE):
    rows = ladders.collected(spark.createDataFrame(targets, TARGET), spark.createDataFrame(ads, AD), ladder).collect()
    return {r["target_id"]: (r["precision"], r["total"], [(s["step"], s["added"]) for s in r["log"]]) for r in rows}


def test_ladders_stop_where_they_should(spark):
    ads = [ad(p) for p in range(12)] + [ad(p) for p in range(6)]  # the same price and mileage counts once
    ads += [ad(100 + p, region="south", lat=60.0) for p in range(9)]  # a national search finds these
    ads += [ad(200 + p, make="CITROEN", model="C3", title="used DS 3 here", lat=60.0, region="south") for p in range(4)]
    ads += [ad(300 + p, model="other", title="a DS 3 in the text", lat=60.0) for p in range(50)]
    found = climbed(spark, [target(1), target(2, region=None, lat=None), target(3, make="XX", second=None), target(4, year=1900, fuel=None)], ads)
    # 12 local ads, 9 national ones at the third place: enough with precision 3, so no text search; then the second make.
    assert found[1] == (3, 25, [(1, 12), (2, 0), (3, 0), (4, 9), (5, 0), (6, 0), (7, 0), (9, 0), (10, 4)])
    assert found[2] == (3, 25, [(4, 21), (5, 0), (6, 0), (7, 0), (10, 4)])
    assert found[3][:2] == (None, 0)
    assert found[4][1] == 25


def test_text_searches_fill_what_is_short_and_the_cap_ends(spark):
    few = [ad(p) for p in range(3)]
    titled = [ad(300 + p, model="other", title="a ds 3 in the text", lat=60.0, region="south") for p in range(30)]
    assert climbed(spark, [target(1, second=None)], few + titled)[1] == (1, 33, [(1, 3), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 30)])
    many = [ad(p) for p in range(150)]
    assert climbed(spark, [target(1)], many + titled)[1] == (5, 150, [(1, 150)])
    # Only the make is left in the last rung of the third site.
    assert climbed(spark, [target(1)], [ad(p, model="any") for p in range(25)], ladders.THIRD_SITE)[1] == (1, 25, [(1, 0), (2, 0), (3, 0), (4, 0), (5, 25)])


def test_rungs_that_need_something(spark):
    ads = [ad(p, gearbox="automatic") for p in range(25)]
    assert climbed(spark, [target(1), target(2, gearbox=None)], ads, ladders.SECOND_SITE)[1][0] == 2
    assert climbed(spark, [target(2, gearbox=None)], ads, ladders.SECOND_SITE)[2][0] == 5


def test_pairs_of_targets_and_ads_are_counted_where_they_meet(spark):
    tables = spark.createDataFrame([target(i) for i in range(3)], TARGET), spark.createDataFrame([ad(p) for p in range(3)], AD)
    for ladder in (ladders.FIRST_SITE, ladders.SECOND_SITE, ladders.THIRD_SITE):
        plan = ladders.collected(*tables, ladder)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ad_price" in line]
        # Ads alone are dealt by their prices; no target goes along.
        assert dealt and not any("target_id" in line or "_profile" in line for line in dealt)


def test_a_price_of_several_ads_counts_in_its_first_rung(spark):
    # The same prices, near with another gearbox, far with any, and under other years: each counts once, where it is first met.
    ads = [ad(p, lat=lat, region=region, gearbox=gearbox, year=year) for p in range(30) for lat, region in ((45.0, "north"), (60.0, "south")) for gearbox, year in (("automatic", 2000), ("manual", 2002), (None, 2000))]
    assert climbed(spark, [target(1, second=None)], ads)[1] == (4, 30, [(1, 0), (2, 0), (3, 30), (4, 0), (5, 0), (6, 0), (7, 0)])
    assert climbed(spark, [target(1, second=None, gearbox=None)], ads)[1] == (5, 30, [(1, 30), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0)])
    # Targets that ask the same have the same log, each its own row.
    assert set(climbed(spark, [target(i, second=None) for i in range(5)], ads)) == set(range(5))


def test_empty_tables(spark):
    some = spark.createDataFrame([target(1)], TARGET), spark.createDataFrame([ad(1)], AD)
    assert ladders.collected(some[0].limit(0), some[1]).count() == 0
    assert ladders.collected(some[0], some[1].limit(0)).collect()[0]["total"] == 0


def by_force(t, ads, ladder, enough, most):
    """A target's log, rung by rung over all ads."""
    i, make, model, year, fuel, gearbox, hp, km, region, lat, _, second, has_gearbox, is_hybrid = t
    low, high = {5000: (0, 20000), 50000: (20000, 80000), 200000: (100000, 10**9), None: (0, 10**9)}[km]
    seen, log = set(), []
    for step, r in enumerate(ladder, 1):
        needs = {"local": lat is not None, "region": region is not None}.get(r.place, True) and (r.kind != "second" or second is not None) and (r.needs is None or {"has_gearbox": has_gearbox, "is_hybrid": is_hybrid}[r.needs])
        if not needs or len(seen) >= most or (r.kind == "text" and len(seen) >= enough):
            continue
        tests = {"fuel": lambda a: fuel in (None, a[4]), "gearbox": lambda a: gearbox in (None, a[5]), "hp": lambda a: hp is None or (a[6] is not None and abs(a[6] - hp) <= 5), "km": lambda a: low <= a[7] <= high}
        titled = lambda a: f"{make} {model}".lower() in a[2].lower()
        kinds = {"model": lambda a: (a[0], a[1]) == (make, model), "make": lambda a: a[0] == make, "text": lambda a: a[0] == make and titled(a), "second": lambda a: a[0] == second and titled(a)}
        places = {"national": lambda a: True, "region": lambda a: a[8] == region, "local": lambda a: abs(a[9] - lat) < 0.2}
        found = {(a[11], a[7]) for a in ads if kinds[r.kind](a) and places[r.place](a) and (year is None or year < 1990 or abs(a[3] - year) <= r.years) and all(tests[f](a) for f in r.filters)} - seen
        seen |= found
        log.append((step, len(found)))
    return log


def test_stages_give_what_all_rungs_give(spark):
    """Targets that one stage leaves short and those that it fills, with missing fuels, powers, years and places."""
    assert [ladders._stages(x) for x in (ladders.FIRST_SITE, ladders.SECOND_SITE, ladders.THIRD_SITE)] == [[5, 10], [6, 8], [2, 4, 5]]
    r = random.Random(4)
    one = lambda *x: r.choice(x)
    targets, ads = [], []
    for i in range(60):
        gearbox = one("manual", "automatic", None)
        targets.append((i, one("DS", "DS", "XX"), one("3", "4"), one(2000, 2002, 1900, None), one("petrol", "diesel", None), gearbox, one(100, 104, None), one(5000, 50000, 200000, None), one("north", "south", None), one(45.0, 46.0, None), 5.0, one("CITROEN", None), gearbox is not None, one(True, False)))
    for _ in range(900):
        make, model = one("DS", "DS", "CITROEN"), one("3", "4")
        ads.append((make, model, one("", f"used {make} {model}", f"a ds {model}"), one(1999, 2000, 2001, 2002, 2003), one("petrol", "diesel", None), one("manual", "automatic", None), one(95, 100, 106, 120, None), one(8000, 30000, 70000, 150000), one("north", "south", None), one(45.0, 46.0, 60.0), 5.0, r.randrange(60)))
    tables = spark.createDataFrame(targets, TARGET), spark.createDataFrame(ads + ads[:300], AD)
    for ladder in (ladders.FIRST_SITE, ladders.SECOND_SITE, ladders.THIRD_SITE):
        found = {x["target_id"]: [(s["step"], s["added"]) for s in x["log"]] for x in ladders.collected(*tables, ladder, 10, 25).collect()}
        assert found == {t[0]: by_force(t, ads, ladder, 10, 25) for t in targets}
        assert len({len(x) for x in found.values()}) > 2


def offers_of(spark, rows):
    return spark.createDataFrame(rows, "make string, year int, fuel string, hp_range string, offer_id int")


def test_power_tiers(spark):
    asks = spark.createDataFrame([(1, "A", 2000, "diesel", "min-90"), (2, "A", 2000, "diesel", None), (3, "A", 2003, "petrol", "min-90"), (4, "A", 2000, None, "x"), (5, "B", 2000, "diesel", None), (6, None, 2000, "diesel", None), (7, "A", None, "diesel", None)], "ask int, make string, year int, fuel string, hp string")
    offers = offers_of(spark, [("A", 2000, "Diesel", " MIN-90 ", 9), ("A", 2000, "diesel", None, 8), ("A", 2000, "diesel", "70-120", 1), ("A", 2000, None, None, 7), ("A", 2001, "petrol", "70-120", 2), ("A", 2002, "petrol", "70-120", 3), ("A", 2006, "petrol", "70-120", 4), (None, 2000, "diesel", None, 5)])
    found = {r["ask"]: (r["tier"], r["power_tier"], r["offer"] and r["offer"]["offer_id"]) for r in cascade.with_best_offer(asks, offers, ["make"], "hp").collect()}
    assert found == {1: (1, 1, 9), 2: (1, 2, 8), 3: (3, 3, 3), 4: (2, 2, 7), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None)}


def test_cascade(spark):
    rows = [
        (1, 100, 3, 100, 50, None, None, None, None, 100),  # market mean
        (2, 100, 3, 0, 80, 90, None, None, None, 100),  # no mean: the median
        (3, 100, 2, 100, 50, 110, None, None, None, 100),  # too few samples: seed
        (4, 100, 2, 100, 50, None, None, None, None, 500),  # few are enough for a rare one
        (5, 100, None, None, None, None, 100, 200, 900, None),  # estimate, halved
        (6, 100, None, None, None, 0, 0, 200, 200, None),  # quotation, halved
        (7, 100, None, None, None, None, None, 200, -1, None),  # nothing
        (8, None, 9, 100, 100, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, price int, n int, mean int, median int, seed int, low int, high int, quotation int, hp int")
    c = F.col
    ref = cascade.reference(F.struct(c("n").alias("sample_count"), c("mean").alias("price_iqr_mean"), c("median").alias("price_median")), c("seed"), c("low"), c("high"), c("quotation"), c("hp"), F.lit("market"))
    df = df.withColumn("ref", ref).withColumns({"l4": cascade.against_reference(c("price"), c("ref"), [c("id")]), "old": cascade.stale(c("price"), c("ref"), F.lit(31)), "new": cascade.stale(c("price"), c("ref"), F.lit(30))})
    found = {r["id"]: (r["ref"]["source"], r["ref"]["price"], len(r["ref"]["tried"]), r["l4"]["status"], r["l4"]["detail"], r["old"], r["new"]) for r in df.collect()}
    assert found == {
        1: ("market", 100.0, 1, "pass", "0.0", False, False), 2: ("market", 80.0, 1, "warning", "25.0", False, False), 3: ("argus_seed", 110.0, 2, "pass", "-9.1", False, False), 4: ("market", 100.0, 1, "pass", "0.0", False, False),
        5: ("estimate", 150.0, 3, "warning", "-16.7", True, False), 6: ("quotation", 200.0, 4, "warning", "-25.0", True, False), 7: (None, None, 4, "skip", None, False, False), 8: ("market", 100.0, 1, "skip", None, False, False),
    }
