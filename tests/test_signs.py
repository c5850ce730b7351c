"""Phone plans, signs of imports and reference prices, on rows whose answers are known."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as texts
from marketlens.operators import rules, signs

lit = lambda x, kind="string": F.lit(x).cast(kind)


def plan(phone, *rest):
    number = texts.phone_digits(F.trim(phone))
    return signs.phone_plan(number, texts.country_of_number(number), *rest)


def imports(title, description, country, phone, *rest):
    words = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return rules.imported_by(signs.import_weight(words, country, texts.dial_country(phone), *rest))


def one(spark, column):
    r = spark.range(1).select(column.alias("r")).first()["r"]
    return r["status"], r["score"]


@pytest.mark.parametrize(
    "phone, country, owner, has_phone, site_hides, expected",
    [
        (None, "FR", "pro", False, True, ("neutral", 0.0)), (" ", "FR", "pro", True, None, ("neutral", 0.0)), (None, None, None, False, None, ("warning", 0.2)), ("", "FR", "pro", None, False, ("fail", 0.0)),
        ("+49 171 123", "FR", None, None, None, ("warning", 0.3)), ("00352 123", None, None, None, None, ("warning", 0.3)), ("+41 79 123 45 67", "CH", None, None, None, ("pass", 1.0)), ("022 123 45 67", "ch", None, None, None, ("pass", 1.0)),
        ("+33 1 62 12 34 56", "FR", None, None, None, ("fail", 0.1)), ("09475 12345", "FR", None, None, None, ("fail", 0.1)), ("0644.66.12.34", "FR", None, None, None, ("warning", 0.3)), ("06 12 34 56 78", "FR", None, None, None, ("pass", 1.0)),
        ("0033 9 12 34 56 78", "FR", None, None, None, ("pass", 1.0)), ("08 12 34 56 78", "FR", None, None, None, ("pass", 0.8)), ("+49(0)271 123456", "DE", None, None, None, ("pass", 1.0)), ("12", "DE", None, None, None, ("pass", 0.8)),
        ("0470 12", "BE", None, None, None, ("pass", 0.7)), ("+32 470", "BE", None, None, None, ("pass", 0.8)), ("+99 1", "BE", None, None, None, ("pass", 0.8)),
    ],
)
def test_phone_plans(spark, phone, country, owner, has_phone, site_hides, expected):
    assert one(spark, plan(lit(phone), lit(country), lit(owner), lit(has_phone, "boolean"), lit(site_hides, "boolean"))) == expected


@pytest.mark.parametrize(
    "text, country, status",
    [
        ("un import rare", "FR", "warning"), ("important, importateur", "FR", "pass"), ("import-export", "FR", "warning"), ("venu de Suisse", "CH", "pass"), ("venu de Suisse", "FR", "warning"), ("unfallwagen", "DE", "pass"),
        ("unfallwagen importiert", "DE", "warning"), ("véhicule importé d'Allemagne", "FR", "fail"), ("avec coc", "FR", "warning"), ("coco", "FR", "pass"), ("homologation", "FR", "pass"), ("homologation, malus payé", "FR", "warning"), (None, None, "pass"),
    ],
)
def test_words_of_imports(spark, text, country, status):
    none = lit(None)
    assert one(spark, imports(none, lit(text), lit(country), none, lit(None, "int"), lit(None, "int"), F.lit(False), none, F.lit(False)))[0] == status


def test_other_signs_of_imports(spark):
    sign = lambda price, age, pro, number, checked, phone=None: one(spark, imports(lit("x"), lit(None), lit("FR"), lit(phone), lit(price, "int"), lit(age, "int"), lit(pro, "boolean"), lit(number), lit(checked, "boolean")))[0]
    assert sign(2999, 7, False, None, None) == "warning" and sign(3000, 7, False, None, None) == "pass" and sign(2999, 8, None, None, None) == "pass"
    assert sign(None, None, True, " ", False) == "pass" and sign(None, None, True, "", False) == "warning" and sign(None, None, True, None, True) == "pass"
    assert sign(100, 1, True, None, None, "+49 1") == "fail"


def test_reference_prices_widen(spark):
    offers = "array(" + ", ".join(f"named_struct('fuel', {f}, 'hp_range', {h}, 'sample_count', {n}, 'price_min', {a}, 'price_median', {b}, 'price_max', {c})" for f, h, n, a, b, c in [("'d'", "'p'", 3, 1, 2, 3), ("'d'", "CAST(NULL AS STRING)", 3, 4, 5, 6), ("'d'", "'q'", 3, 7, 0, 9), ("'e'", "'p'", 2, 10, 11, 12), ("CAST(NULL AS STRING)", "CAST(NULL AS STRING)", 9, 13, 14, 15)]) + ")"
    rows = spark.sql(f"SELECT {offers} AS o")
    found = lambda fuel, power, least=3: rows.select(signs.reference_prices(F.col("o"), lit(fuel), lit(power), 3, least)).first()[0]
    assert found("D", "P") == [1, 2, 3] and found("d", "x") == [4, 5, 6] and found("d", None) == [4, 5, 6] and found("d", "p", 5) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert found("e", "p") == [1, 2, 3] and found(None, "x") == [4, 5, 6, 13, 14, 15] and found("z", "q", 99) is None
    m = rows.select(signs.moments(F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0)))).first()[0]
    assert (m["mean"], round(m["deviation"], 6), m["n"]) == (3.0, 2.160247, 3)
    assert rows.select(signs.moments(F.array().cast("array<double>"))).first()[0] is None
