"""Queries that build the vehicle registry: imports, candidates for new vehicles, and coverage snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, factory
from ..session import table
from .queries import NOW, now, query

MAKES = [f"Brand#{i}" for i in range(1, 25)]


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.withColumns({"make": F.col("p_brand"), "model": F.concat_ws(" ", "p_type", (F.col("p_size") % 7).cast("string"))})


PARTS = "parts AS (SELECT *, p_brand AS make, p_type || ' ' || (p_size % 7) AS model FROM part)"


@query("WITH " + PARTS + """, vehicles AS (SELECT s_suppkey AS vehicle_id, make, model, CASE WHEN s_suppkey % 3 > 0 THEN 'g' || (s_suppkey % 3) END AS generation, CASE WHEN s_suppkey % 5 > 0 THEN 1985 + p_size % 9 END AS year_start, CASE WHEN s_suppkey % 4 > 0 THEN 1994 + p_size % 5 END AS year_end FROM supplier JOIN parts ON s_suppkey = p_partkey),
specs AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS vehicle_id, CASE WHEN c_custkey % 6 > 0 THEN 't' || (c_custkey % 13) END AS trim FROM customer),
raw AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, make, CASE WHEN l_orderkey % 50 > 0 THEN model ELSE ' ' END AS model, CASE WHEN l_linenumber % 3 > 0 THEN 'g' || (l_linenumber % 3) END AS generation, CASE WHEN l_suppkey % 11 > 0 THEN 't' || (l_suppkey % 11) END AS trim,
  CASE WHEN l_partkey % 6 > 0 THEN 1980 + l_partkey % 17 END AS year_from, CASE WHEN l_partkey % 5 > 0 THEN 1993 + l_partkey % 11 END AS year_to FROM lineitem JOIN parts ON l_partkey = p_partkey WHERE make <> 'Brand#25'),
-- Rows that are equal in all of this are one row.
sheet AS (SELECT DISTINCT line, make, model, coalesce(generation, '') AS generation, coalesce(trim, '') AS trim, year_from, year_to FROM raw WHERE trim(model) <> ''),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY make, model, generation ORDER BY line) AS rn FROM sheet) WHERE rn = 1),
named AS (SELECT f.*, coalesce((SELECT max(vehicle_id) FROM vehicles v WHERE v.make = f.make AND v.model = f.model AND coalesce(v.generation, '') = f.generation), (SELECT min(vehicle_id) FROM vehicles v WHERE v.make = f.make AND v.model = f.model)) AS vehicle_id, EXISTS (SELECT 1 FROM vehicles v WHERE v.make = f.make AND v.model = f.model AND coalesce(v.generation, '') = f.generation) AS exact FROM firsts f),
wider AS (SELECT vehicle_id, min(year_from) AS low, max(year_to) AS high FROM named WHERE NOT exact AND vehicle_id IS NOT NULL GROUP BY vehicle_id),
old AS (SELECT v.vehicle_id, make, model, generation, least(year_start, low) AS y0, greatest(year_end, high) AS y1, CASE WHEN least(year_start, low) IS DISTINCT FROM year_start OR greatest(year_end, high) IS DISTINCT FROM year_end THEN 'widened' ELSE 'kept' END AS disposition FROM vehicles v LEFT JOIN wider w ON w.vehicle_id = v.vehicle_id),
new AS (SELECT NULL::BIGINT AS vehicle_id, make, model, arg_min(generation, line) AS generation, min(year_from) AS y0, max(year_to) AS y1, 'created' AS disposition FROM named WHERE vehicle_id IS NULL GROUP BY make, model),
owned AS (SELECT s.*, coalesce(CAST(n.vehicle_id AS VARCHAR), s.make || '|' || s.model) AS owner, n.vehicle_id FROM sheet s JOIN named n ON s.make = n.make AND s.model = n.model AND s.generation = n.generation),
done AS (SELECT owner, CASE WHEN row_number() OVER (PARTITION BY owner, trim ORDER BY line) = 1 AND NOT EXISTS (SELECT 1 FROM specs x WHERE x.vehicle_id = o.vehicle_id AND coalesce(x.trim, '') = o.trim) THEN 1 ELSE 0 END AS fresh FROM owned o),
n AS (SELECT owner, sum(fresh)::BIGINT AS created, count(*) - sum(fresh)::BIGINT AS skipped FROM done GROUP BY owner)
SELECT v.vehicle_id, make, model, generation, CAST(y0 AS INT) AS year_start, CAST(y1 AS INT) AS year_end, disposition, coalesce(created, 0)::BIGINT AS created, coalesce(skipped, 0)::BIGINT AS skipped FROM (SELECT * FROM old UNION ALL SELECT * FROM new) v LEFT JOIN n ON n.owner = coalesce(CAST(v.vehicle_id AS VARCHAR), make || '|' || model)""")
def enr_import(spark, sf_dir):  # ENR6
    c, p = F.col, _parts(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    k = c("s_suppkey")
    vehicles = s.join(p, k == c("p_partkey")).select(k.alias("vehicle_id"), "make", "model", F.when(k % 3 > 0, F.concat(F.lit("g"), (k % 3).cast("string"))).alias("generation"), F.when(k % 5 > 0, 1985 + c("p_size") % 9).alias("year_start"), F.when(k % 4 > 0, 1994 + c("p_size") % 5).alias("year_end"))
    specs = table(spark, sf_dir, "customer").select((c("c_custkey") % s.count()).alias("vehicle_id"), F.when(c("c_custkey") % 6 > 0, F.concat(F.lit("t"), (c("c_custkey") % 13).cast("string"))).alias("trim"))
    l = table(spark, sf_dir, "lineitem").join(p, c("l_partkey") == c("p_partkey"))
    rows = l.where(c("make").isin(MAKES)).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), "make", F.when(c("l_orderkey") % 50 > 0, c("model")).otherwise(" ").alias("model"), F.when(c("l_linenumber") % 3 > 0, F.concat(F.lit("g"), (c("l_linenumber") % 3).cast("string"))).alias("generation"),
        F.when(c("l_suppkey") % 11 > 0, F.concat(F.lit("t"), (c("l_suppkey") % 11).cast("string"))).alias("trim"), F.when(c("l_partkey") % 6 > 0, 1980 + c("l_partkey") % 17).cast("int").alias("year_from"), F.when(c("l_partkey") % 5 > 0, 1993 + c("l_partkey") % 11).cast("int").alias("year_to"),
    ).distinct()
    after, done = factory.imported(vehicles, specs, rows)
    owner = F.coalesce(c("vehicle_id").cast("string"), F.concat_ws("|", "make", "model")).alias("owner")
    n = done.groupBy(owner).agg(F.count_if(c("disposition") == "created").alias("created"), F.count_if(c("disposition") == "skipped").alias("skipped"))
    return after.withColumn("owner", F.coalesce(c("vehicle_id").cast("string"), F.concat_ws("|", "make", "model"))).join(n, "owner", "left").na.fill(0, ["created", "skipped"]).drop("owner")


@query("WITH " + PARTS + """, asks AS (SELECT DISTINCT CASE WHEN p_partkey % 40 = 0 THEN 'Audi' ELSE make END AS make, CASE WHEN p_partkey % 40 = 0 THEN 'Allroad' WHEN p_partkey % 41 = 0 THEN 'Autres' ELSE upper(model) END AS model FROM parts),
k AS (SELECT *, regexp_replace(lower(make), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(model), '[^a-z0-9]', '', 'g') AS b FROM asks),
keyed AS (SELECT *, regexp_replace(lower(make), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(model), '[^a-z0-9]', '', 'g') AS b FROM parts),
v AS (SELECT DISTINCT a, b FROM supplier JOIN keyed ON p_partkey = s_suppkey), s AS (SELECT a, b, count(*) AS n FROM customer JOIN keyed ON p_partkey = c_custkey GROUP BY a, b),
m AS (SELECT a, b, sum(CASE WHEN l_partkey % 3 > 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END)::BIGINT AS n, CAST(min(year(l_shipdate)) AS INT) AS y0, CAST(max(year(l_shipdate)) AS INT) AS y1 FROM lineitem JOIN keyed ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY a, b),
x AS (SELECT a, b, count(*) AS n, min(1980 + s_suppkey % 9) AS y0, max(CASE WHEN s_suppkey % 2 = 0 THEN 1999 + s_suppkey % 5 END) AS y1 FROM supplier JOIN keyed ON p_partkey = s_suppkey + 50 GROUP BY a, b),
f AS (SELECT k.make, k.model, CASE WHEN k.model = 'Autres' OR k.model = 'Allroad' THEN 'generic' WHEN v.a IS NOT NULL THEN 'known' WHEN x.n IS NULL AND coalesce(s.n, 0) < 3 THEN 'scans' WHEN x.n IS NULL AND coalesce(m.n, 0) < 20 THEN 'samples' ELSE 'eligible' END AS reason,
  coalesce(s.n, 0) AS scan_count, coalesce(m.n, 0) AS market_samples, coalesce(x.n, 0) AS csv_specs, coalesce(x.y0, m.y0) AS y0, coalesce(x.y1, m.y1) AS y1
  FROM k LEFT JOIN v ON v.a = k.a AND v.b = k.b LEFT JOIN s ON s.a = k.a AND s.b = k.b LEFT JOIN m ON m.a = k.a AND m.b = k.b LEFT JOIN x ON x.a = k.a AND x.b = k.b)
SELECT make, model, reason, reason = 'eligible' AS eligible, scan_count, market_samples, csv_specs, CASE WHEN reason = 'eligible' THEN y0 END AS year_start, CASE WHEN reason = 'eligible' THEN y1 END AS year_end FROM f""")
def enr_candidates(spark, sf_dir):  # ENR4 ENR5
    c, p = F.col, _parts(spark, sf_dir)
    key = c("p_partkey")
    asks = p.select(F.when(key % 40 == 0, "Audi").otherwise(c("make")).alias("make"), F.when(key % 40 == 0, "Allroad").when(key % 41 == 0, "Autres").otherwise(F.upper("model")).alias("model")).distinct()
    s = table(spark, sf_dir, "supplier")
    vehicles = s.join(p, c("s_suppkey") == key).select("make", "model")
    scans = table(spark, sf_dir, "customer").join(p, c("c_custkey") == key).select("make", "model")
    market = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(p, c("l_partkey") == key).select("make", "model", F.year("l_shipdate").alias("year"), F.when(c("l_partkey") % 3 > 0, c("l_quantity").cast("long")).otherwise(0).alias("sample_count"))
    sheet = s.join(p, c("s_suppkey") + 50 == key).select("make", "model", (1980 + c("s_suppkey") % 9).alias("year_from"), F.when(c("s_suppkey") % 2 == 0, 1999 + c("s_suppkey") % 5).alias("year_to"))
    return factory.candidates(asks, vehicles, scans, market, sheet)


@query("""WITH v AS (SELECT p_partkey AS key, p_size % 3 > 0 AS has_tokens, p_size % 4 > 0 AS has_slugs, CASE WHEN p_size * 10 > 420 THEN 5 WHEN p_size * 10 > 300 THEN 10 ELSE 20 END AS least FROM part),
sp AS (SELECT s_suppkey * 3 AS key, count(*) AS n, max(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 50 END)::BIGINT AS max_hp, string_agg(DISTINCT CASE WHEN s_nationkey % 3 > 0 THEN 'f' || (s_nationkey % 3) END, ',' ORDER BY CASE WHEN s_nationkey % 3 > 0 THEN 'f' || (s_nationkey % 3) END) AS fuels FROM supplier GROUP BY 1),
ti AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_acctbal > 0), ma AS (SELECT l_partkey * 2 AS key, CASE l_linenumber % 4 WHEN 0 THEN 'CH' WHEN 1 THEN NULL ELSE 'FR' END AS country, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS n, l_suppkey % 60 = 0 AS est, l_shipdate + INTERVAL 600 DAY AS fresh FROM lineitem),
mm AS (SELECT ma.key, count(*) AS markets, sum(n)::BIGINT AS samples, count(*) FILTER (WHERE n < CASE WHEN coalesce(country, 'FR') = 'FR' THEN least ELSE greatest(least // 2, 5) END) AS insufficient, count(*) FILTER (WHERE est) AS estimates, count(*) FILTER (WHERE country = 'CH') AS abroad, count(*) FILTER (WHERE fresh > TIMESTAMP '""" + NOW + """') AS fresh FROM ma JOIN v ON ma.key = v.key GROUP BY ma.key),
se AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P'), vi AS (SELECT user_id AS key, count(*) AS n FROM events WHERE event_type = 'view' AND value > 10 GROUP BY 1), sy AS (SELECT DISTINCT user_id + 100 AS key FROM events WHERE event_type = 'signup'),
sc AS (SELECT user_id AS key, count(*) AS n, count(*) FILTER (WHERE seen >= TIMESTAMP '""" + NOW + """' - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE seen >= TIMESTAMP '""" + NOW + """' - INTERVAL 30 DAY) AS month FROM (SELECT user_id, ts - INTERVAL 8060 DAY AS seen FROM events WHERE event_type = 'click') GROUP BY 1),
g AS (SELECT v.key, coalesce(sp.n, 0) AS specs, sp.max_hp, coalesce(sp.fuels, '') AS fuels, coalesce(markets, 0) AS markets, coalesce(samples, 0) AS samples, coalesce(insufficient, 0) AS insufficient, coalesce(fresh, 0) AS fresh, coalesce(vi.n, 0) AS transcripts, coalesce(sc.n, 0) AS scans, coalesce(week, 0) AS scans_week, coalesce(month, 0) AS scans_month,
  list_filter([CASE WHEN sp.key IS NULL THEN 'specs' END, CASE WHEN ti.key IS NULL THEN 'tires' END, CASE WHEN markets IS NULL THEN 'market' END, CASE WHEN insufficient = markets THEN 'weak market' END, CASE WHEN se.key IS NULL THEN 'seed' END, CASE WHEN coalesce(estimates, 0) = 0 THEN 'estimate' END, CASE WHEN coalesce(abroad, 0) = 0 THEN 'abroad' END,
    CASE WHEN vi.key IS NULL AND sy.key IS NULL THEN 'videos' END, CASE WHEN sc.key IS NULL THEN 'scans' END, CASE WHEN NOT has_tokens THEN 'tokens' END, CASE WHEN NOT has_slugs THEN 'slugs' END], lambda x: x IS NOT NULL) AS gaps
  FROM v LEFT JOIN sp ON sp.key = v.key LEFT JOIN ti ON ti.key = v.key LEFT JOIN mm ON mm.key = v.key LEFT JOIN se ON se.key = v.key LEFT JOIN vi ON vi.key = v.key LEFT JOIN sy ON sy.key = v.key LEFT JOIN sc ON sc.key = v.key)
SELECT key, specs, max_hp, fuels, markets, samples, insufficient, fresh, transcripts, scans, scans_week, scans_month, array_to_string(gaps, ',') AS gaps, CAST(len(gaps) AS INT) AS gap_count, CAST(round_even(100.0::DOUBLE * (10 - len(gaps)) / 10, 0) AS INT) AS readiness,
  CASE WHEN len(gaps) >= 5 OR (markets = 0 AND scans = 0) THEN 'critical' WHEN len(gaps) >= 2 THEN 'attention' ELSE 'healthy' END AS status FROM g""")
def cov_snapshot(spark, sf_dir):  # COV3
    c = F.col
    t = lambda name: table(spark, sf_dir, name)
    hp = c("p_size") * 10
    vehicles = t("part").select(c("p_partkey").alias("key"), (c("p_size") % 3 > 0).alias("has_tokens"), (c("p_size") % 4 > 0).alias("has_slugs"), F.when(hp > 420, 5).when(hp > 300, 10).otherwise(20).alias("least_samples"))
    nation = c("s_nationkey") % 3
    specs = t("supplier").select((c("s_suppkey") * 3).alias("key"), F.when(nation > 0, F.concat(F.lit("f"), nation.cast("string"))).alias("fuel"), F.when(c("s_suppkey") % 4 > 0, c("s_suppkey") % 50).alias("hp"))
    country = F.when(c("l_linenumber") % 4 == 0, "CH").when(c("l_linenumber") % 4 > 1, "FR")
    market = t("lineitem").select((c("l_partkey") * 2).alias("key"), country.alias("country"), F.when(c("l_partkey") % 5 == 0, 1).otherwise(c("l_quantity").cast("long")).alias("sample_count"), (c("l_suppkey") % 60 == 0).alias("has_estimate"), (c("l_shipdate") + F.expr("INTERVAL 600 DAYS")).alias("refresh_after"))
    e = t("events").withColumn("key", c("user_id"))
    found = coverage.snapshot(
        vehicles, now(), specs, t("customer").where("c_acctbal > 0").select(c("c_custkey").alias("key")), market, t("orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("key")),
        e.where("event_type = 'view'").select("key", F.when(c("value") > 10, F.length("props")).alias("transcript_chars")), e.where("event_type = 'signup'").select((c("key") + 100).alias("key")),
        e.where("event_type = 'click'").select("key", F.lit("site").alias("source"), (c("ts") - F.expr("INTERVAL 8060 DAYS")).alias("created_at")),
    )
    shown = ["key", "specs", "max_hp", "markets", "samples", "insufficient", "fresh", "transcripts", "scans", "scans_week", "scans_month", "gap_count", "readiness", "status"]
    return found.select(*shown, F.array_join("fuels", ",").alias("fuels"), F.array_join("gaps", ",").alias("gaps"))
