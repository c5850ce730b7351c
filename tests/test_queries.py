import pytest

from marketlens.plans import collection, filters, more, names, outputs, pages, prices, queries, registry  # noqa: F401

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(found) > 0
    assert rows_of(found) == rows_of(duck.sql(queries.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
