"""Accents of all code points against Python's tables, and display names whose forms are known."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text, titles, unicode


def test_every_code_point_folds_as_python_does(spark):
    codes = [c for c in (*range(1, 0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0100, 0xE01F0))]
    rows = spark.createDataFrame([(c, "x" + chr(c) + "é") for c in codes], "code int, value string")
    wrong = [r["code"] for r in rows.select("code", "value", unicode.without_accents(F.col("value")).alias("found")).collect() if r["found"] != unicode.folded(r["value"])]
    assert not wrong
    assert spark.range(1).select(unicode.without_accents(F.lit(None).cast("string"))).first()[0] is None


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_fast_form_leaves_what_becomes_several(spark):
    assert one(spark, unicode.without_accents(F.lit("ﬁé½ő"), exact=False)) == "ﬁe½o"
    assert one(spark, unicode.without_accents(F.lit("ﬁé½ő한"))) == "fie1⁄2o한"


def test_market_form_keeps_case(spark):
    assert one(spark, text.market_form(F.lit(" Île  de\tFrance--Sud ’x‘ "))) == "Ile de France-Sud 'x'"
    assert one(spark, text.market_text(F.lit("ÎLE"))) == "ile"


@pytest.mark.parametrize(
    "name, title",
    [("golf VII", "Golf VII"), ("clio 1.5 dCi tdi", "Clio 1.5 DCI Tdi"), ("c-hr", "C-Hr"), ("e-208 gt", "E-208 GT"), ("x5", "X5"), ("T–Roc  R-line", "T-Roc R-Line"), ("500-x", "500-X"), ("série 3", "Serie 3"), ("", ""), ("i.4", "I.4"), ("a.b", "A.b"), ("-", ""), ("mix", "MIX")],
)
def test_smart_title(spark, name, title):
    assert one(spark, titles.smart_title(F.lit(name))) == title


def test_generations_and_variants(spark):
    assert one(spark, titles.generation_label(F.lit("Golf (phase ii) (b)"))) == "PHASE II"
    assert one(spark, titles.generation_label(F.lit("Golf ()"))) is None
    variant = lambda g, m: one(spark, titles.body_variant(F.lit(g), F.lit(m)))
    assert variant("Mégane", "Megane - estate (IV)") == "Estate"
    assert variant("Golf", "Golf (VII)") is None and variant("", "Break") == "Break" and variant("Golf", "Polo") == "Polo" and variant("Golf", "(x)") is None


@pytest.mark.parametrize(
    "title, make, model",
    [("Renault Symbioz Esprit Alpine 2025", "Renault", "Symbioz"), ("PEUGEOT E-5008 GT 2025", "Peugeot", "E-5008"), ("Renault 2025 neuf, full options", "Renault", None), (None, "x", None), ("x", None, None), ("", "x", None), ("Renault", "Renault", None), ("Other (Kadjar)", "Renault", "Other")],
)
def test_model_from_title(spark, title, make, model):
    assert one(spark, titles.model_from_title(F.lit(title).cast("string"), F.lit(make).cast("string"))) == model


def test_names_that_say_nothing(spark):
    generic = lambda model, make: one(spark, titles.is_generic_model(F.lit(model).cast("string"), F.lit(make).cast("string")))
    assert generic(" Modèle ", None) and generic("Benz", "MERCEDES") and not generic("Benz", "audi") and not generic(None, "audi") and not generic("Golf", None)
    assert one(spark, titles.is_generic_make(F.lit("N/A"))) and not one(spark, titles.is_generic_make(F.lit(None).cast("string")))
