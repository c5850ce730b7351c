"""Queries that write: published versions, logged runs, and streams with deadlines run over all events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..session import new_path, table
from ..sinks import publish, runs
from ..streaming import deadlines
from .queries import query


@query("""SELECT 'part' AS name, 1 AS number, count(*) AS rows, sum(CAST(round(p_retailprice * 100) AS BIGINT))::BIGINT AS cents FROM part UNION ALL SELECT 'part', 2, count(*), 2 * sum(CAST(round(p_retailprice * 100) AS BIGINT))::BIGINT FROM part
UNION ALL SELECT 'supplier', 1, count(*), sum(CAST(round(s_acctbal * 100) AS BIGINT))::BIGINT FROM supplier UNION ALL SELECT 'supplier', 3, count(*), sum(CAST(round(s_acctbal * 100) AS BIGINT))::BIGINT FROM supplier""")
def snk_publish(spark, sf_dir):  # SNK4
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    base = new_path(spark, "published")
    publish.publish({"part": part, "supplier": supplier}, base, "First version!", required=("part",))
    publish.publish({"part": part.withColumn("p_retailprice", F.col("p_retailprice") * 2)}, base, "second")
    publish.roll_back(spark, base, 1)
    cents = lambda name, value, number: publish.table(spark, base, name, number).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents")).select(F.lit(name).alias("name"), F.lit(number or publish.manifest(spark, base)["number"]).alias("number"), "rows", "cents")
    return cents("part", "p_retailprice", 1).unionByName(cents("part", "p_retailprice", 2)).unionByName(cents("supplier", "s_acctbal", 1)).unionByName(cents("supplier", "s_acctbal", None))


@query("""SELECT 'orders' AS name, 'success' AS status, (SELECT count(*) FROM orders) AS count, NULL AS error, 2 AS logged UNION ALL SELECT 'open orders', 'success', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') + (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'), NULL, 2
UNION ALL SELECT 'broken', 'failure', NULL, 'ValueError: nothing to import', 2""")
def snk_runs(spark, sf_dir):  # PIPE SNK3
    path, out = new_path(spark, "runs"), new_path(spark, "run-output")
    orders = table(spark, sf_dir, "orders")
    with runs.tracked(spark, path, "orders") as run:
        run.observe(orders).write.parquet(f"{out}/orders")
    with runs.tracked(spark, path, "open orders") as run:
        for status in "OP":
            run.observe(orders.where(F.col("o_orderstatus") == status)).write.parquet(f"{out}/{status}")
    try:
        with runs.tracked(spark, path, "broken"):
            raise ValueError("nothing to import")
    except ValueError:
        pass
    logged = spark.read.schema(runs.RUN).parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("logged"))
    return runs.runs(spark, path).join(logged, "run_id").select("name", "status", "count", "error", "logged")


@query("""WITH e AS (SELECT user_id, event_type = 'click' AS opens, epoch_us(ts) // 1000 AS t, event_id FROM events WHERE event_type IN ('click', 'purchase')),
-- The watermark that closes the last leases: the latest event less the delay.
w AS (SELECT max(t) - 3600000 AS mark FROM e),
n AS (SELECT *, lead(t) OVER o AS next_at, lag(opens) OVER o AS was_open, lag(t) OVER o AS last_at FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, opens DESC)),
f AS (
  SELECT user_id, 'assigned' AS status, t FROM n WHERE opens
  UNION ALL SELECT user_id, 'done', t FROM n WHERE NOT opens AND was_open AND t < last_at + 21600000
  UNION ALL SELECT user_id, 'pending', t + 21600000 FROM n, w WHERE opens AND (next_at >= t + 21600000 OR (next_at IS NULL AND t + 21600000 <= mark)))
SELECT user_id, status, count(*) AS n, md5(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t)) AS times FROM f GROUP BY user_id, status""")
def st_leases(spark, sf_dir):  # ST1 ST4, as a stream over all events
    # A pattern, as a stream takes no path of a single file.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    kind = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "close")
    stream = deadlines.leases(events.select("user_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts")), "user_id", "kind", "ts", timedelta(hours=6))
    rows = deadlines.drained(stream, new_path(spark, "leases"))
    times = F.array_join(F.transform(F.array_sort(F.collect_list(F.unix_millis("at"))), lambda x: x.cast("string")), ",")
    return rows.groupBy(F.col("key").alias("user_id"), "status").agg(F.count(F.lit(1)).alias("n"), F.md5(times.cast("binary")).alias("times"))
