"""Filters whose lookups depend on the kind of an ad: no ad is shuffled or sent to Python for them, and odd ids give the rows of the SQL."""

import pytest

from marketlens.functions import text
from marketlens.operators import signs
from marketlens.plans import filters, prices, queries  # noqa: F401

from .conftest import rows_of
from .test_settled import odd  # noqa: F401


@pytest.mark.parametrize("name", ["rule_price", "rule_all_results", "rule_all_scores"])
def test_lookups_are_settled(spark, odd, name):  # noqa: F811
    folder, con = odd
    found = queries.QUERIES[name](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "ArrowEvalPython" not in plan
    # The joins' code stays below what the JVM compiles at all; what is larger is run in small methods.
    assert name == "rule_price" or int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert rows_of(found.toPandas()) == rows_of(con.sql(queries.SQL[name]).df())


def test_words_and_whole_words(spark):
    rows = [("ad important",), ("ad import.",), ("importé",), ("a.b",), ("axb",), ("coc",), ("coco",), ("",), (None,), ("coco coc",)]
    found = spark.createDataFrame(rows, "t string").select(signs.mentions(queries.F.col("t"), ["a.b", "importé"], ["import", "coc"]).alias("m"))
    assert [r.m for r in found.collect()] == [False, True, True, True, False, True, False, False, False, True]
    assert "RLIKE" in found._jdf.queryExecution().optimizedPlan().toString() and "|importé" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_longest_prefix_of_a_number(spark):
    rows = [("+352621",), ("+33612",), ("+351",), ("+3",), ("0612",), ("",), (None,)]
    found = spark.createDataFrame(rows, "t string").select(text.country_of_number(queries.F.col("t")).alias("c"))
    assert [r.c for r in found.collect()] == ["LU", "FR", None, None, None, None, None]
