"""The test tables in the roles of the analytics: ads, jobs, results; and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path, settled, table


ad_id = lambda: F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _shown(joined: DataFrame, *more) -> DataFrame:
    return joined.select(
        ad_id().alias("ad_id"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.year("l_shipdate").alias("year"), F.col("r_name").alias("region"),
        F.col("n_name").alias("country"), F.col("l_returnflag").alias("fuel"), F.floor("l_extendedprice").cast("long").alias("price"), F.floor(F.col("l_quantity") * 3000).cast("long").alias("km"), F.col("p_size").alias("hp"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("seller"),
        *more,
    )


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ad per line item: make and model are the part's, region and country the buyer's."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return _shown(joined)


def settled_ads(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the ads, for plans that read them several times: the tables meet once, and orders meet their buyers
    first, so that line items are not shuffled for customers.

    The column n_alike, if asked for, is the number of ads with an ad's id. An id begins with its order, so the join by
    order has such ads side by side already.
    """
    t = lambda name: table(spark, sf_dir, name)
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    alike = [F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", ad_id())).alias("n_alike")] * ("n_alike" in columns)
    return settled(_shown(joined, *alike).select(*columns), new_path(spark, "ads"))


ADS = """ads AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ad_id, p_brand AS make, p_type AS model, CAST(year(l_shipdate) AS INT) AS year, r_name AS region, n_name AS country,
         l_returnflag AS fuel, CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(floor(l_quantity * 3000) AS BIGINT) AS km, p_size AS hp, l_shipdate AS ts, l_suppkey AS seller
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order: status and priority from the order, times from its date."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "assigned").otherwise("failed")
    when = F.col("o_orderdate")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("target"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"), when.alias("created_at"), F.when(F.col("o_orderstatus") == "P", when).alias("assigned_at"), F.when(F.col("o_orderstatus") == "F", when).alias("completed_at"), (F.col("o_orderkey") % 3).cast("int").alias("attempts"))


JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS target, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
         CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'assigned' ELSE 'failed' END AS status, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS assigned_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at, CAST(o_orderkey % 3 AS INT) AS attempts
  FROM orders)"""
