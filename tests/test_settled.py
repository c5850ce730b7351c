"""Queries that read the ads several times: tables meet once, and odd ids give the rows of the SQL."""

import os
import shutil

import duckdb
import pytest

from marketlens.plans import filters, prices, queries  # noqa: F401

from .conftest import rows_of

# Copies of some line items under the same id, with other years, fuels and prices; ids with nulls, one of which two items share.
ODD = """SELECT * FROM l UNION ALL SELECT * REPLACE (l_shipdate + INTERVAL 400 DAY AS l_shipdate, 'R' AS l_returnflag, l_extendedprice * 2 AS l_extendedprice) FROM l WHERE l_orderkey % 3 = 0
UNION ALL SELECT * REPLACE (CAST(NULL AS INT) AS l_linenumber, 'A' AS l_returnflag) FROM l WHERE l_orderkey % 5 = 0
UNION ALL SELECT * REPLACE (l_partkey AS l_suppkey, CAST(NULL AS INT) AS l_linenumber, 1 AS l_partkey) FROM l WHERE l_orderkey % 7 = 0
UNION ALL SELECT * REPLACE (1 AS l_linenumber, CAST(NULL AS BIGINT) AS l_suppkey, 'N' AS l_returnflag) FROM l WHERE l_orderkey % 7 = 0"""


@pytest.fixture(scope="module")
def odd(tmp_path_factory, sf_dir):
    folder = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        shutil.copy(f"{sf_dir}/{name}.parquet", folder)
    con.sql(f"CREATE TABLE l AS FROM '{sf_dir}/lineitem.parquet' WHERE l_orderkey % 4 < 2")
    con.sql(f"COPY ({ODD}) TO '{folder}/lineitem.parquet'")
    for path in os.listdir(folder):
        con.sql(f"CREATE VIEW {path[:-8]} AS FROM '{folder}/{path}'")
    return folder, con


@pytest.mark.parametrize("name", ["join_waterfall", "join_ranked_offer"])
def test_tables_meet_once(spark, odd, name):
    folder, con = odd
    found = queries.QUERIES[name](spark, folder)
    assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(found.toPandas()) == rows_of(con.sql(queries.SQL[name]).df())
