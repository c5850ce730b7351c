"""Vehicles created from what is known: imports that find, widen or create, and candidates for a new vehicle.

An import works as if its rows came one after another, but does so by aggregation: the vehicle of a (make, model,
generation) is the one of just that name, else the first of that make and model, whose years are widened, else a new one
named after the first row of the make and model. Only the first row of a generation says its years. A trim that the
vehicle has is skipped, and of rows with one trim the first counts.

Defined cases: rows without a model go; null generations and trims are empty ones; null years widen nothing; empty tables
give empty results; extra columns of rows pass through to the specs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_key
from ..functions.titles import is_generic_model

# Scans that a candidate needs without a sheet of specs, and market samples that it needs then.
LEAST_SCANS, LEAST_SAMPLES = 3, 20
NAME = ["make", "model"]


def assigned(vehicles: DataFrame, rows: DataFrame) -> DataFrame:
    """(make, model, generation, year_from, year_to, line, how, vehicle_id) for each generation of rows: how is exact,
    other (a vehicle of the make and model) or new, with a null id."""
    said = F.struct("year_from", "year_to")
    firsts = rows.groupBy(*NAME, "generation").agg(F.min_by(said, "line").alias("said"), F.min("line").alias("line")).select(*NAME, "generation", "said.*", "line")
    exact = vehicles.groupBy(*NAME, F.coalesce("generation", F.lit("")).alias("generation")).agg(F.max("vehicle_id").alias("exact_id"))
    other = vehicles.groupBy(*NAME).agg(F.min("vehicle_id").alias("other_id"))
    found = firsts.join(exact, [*NAME, "generation"], "left").join(other, NAME, "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("other_id").isNotNull(), "other").otherwise("new")
    return found.select(*NAME, "generation", "year_from", "year_to", "line", how.alias("how"), F.coalesce("exact_id", "other_id").alias("vehicle_id"))


def imported(vehicles: DataFrame, specs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an import leaves: all vehicles, and the rows with what became of each.

    vehicles: vehicle_id, make, model, generation, year_start, year_end; specs: vehicle_id, trim; rows: line (unique and
    in order), make, model, generation, trim, year_from, year_to. The first result adds ``disposition`` (kept, widened or
    created; created ones have no id yet); the second one adds vehicle_id and ``disposition`` (created or skipped).
    """
    filled = rows.where(F.coalesce(F.trim("model"), F.lit("")) != "").withColumns({c: F.coalesce(c, F.lit("")) for c in ("generation", "trim")})
    named = assigned(vehicles, filled)
    years = [F.min(F.nullif("year_from", F.lit(0))).alias("low"), F.max(F.nullif("year_to", F.lit(0))).alias("high")]
    wider = named.where("how = 'other'").groupBy("vehicle_id").agg(*years)
    start, end = F.least("year_start", "low"), F.greatest("year_end", "high")
    old = vehicles.join(wider, "vehicle_id", "left").withColumns({"start": start, "end": end})
    moved = ~(F.col("start").eqNullSafe(F.col("year_start")) & F.col("end").eqNullSafe(F.col("year_end")))
    old = old.select("vehicle_id", *NAME, "generation", F.col("start").alias("year_start"), F.col("end").alias("year_end"), F.when(moved, "widened").otherwise("kept").alias("disposition"))
    new = named.where("how = 'new'").groupBy(*NAME).agg(F.min_by("generation", "line").alias("generation"), *years)
    new = new.select(F.lit(None).cast(vehicles.schema["vehicle_id"].dataType).alias("vehicle_id"), *NAME, "generation", F.col("low").alias("year_start"), F.col("high").alias("year_end"), F.lit("created").alias("disposition"))

    owned = filled.join(named.select(*NAME, "generation", "vehicle_id"), [*NAME, "generation"])
    # A vehicle is known by its id or, if it is new, by its name.
    owner = F.coalesce(F.col("vehicle_id").cast("string"), F.concat_ws("\u0001", F.lit(""), *NAME))
    owned = owned.withColumn("_owner", owner)
    have = specs.select(F.col("vehicle_id").cast("string").alias("_owner"), F.coalesce("trim", F.lit("")).alias("trim")).distinct().withColumn("_had", F.lit(True))
    first = owned.groupBy("_owner", "trim").agg(F.min("line").alias("_first")).join(have, ["_owner", "trim"], "left")
    fresh = F.col("_had").isNull() & (F.col("line") == F.col("_first"))
    done = owned.join(first, ["_owner", "trim"]).withColumn("disposition", F.when(fresh, "created").otherwise("skipped"))
    return old.unionByName(new), done.select(*rows.columns, "vehicle_id", "disposition")


def candidates(asks: DataFrame, vehicles: DataFrame, scans: DataFrame, market: DataFrame, sheet: DataFrame) -> DataFrame:
    """asks (make, model) with what speaks for a vehicle of that name, and the vehicle it would become.

    vehicles and scans have make and model, market also year and sample_count, sheet (of specs) also year_from and year_to.
    Adds reason (generic, known, scans, samples or eligible: the first that holds), eligible, scan_count, market_samples,
    csv_specs, year_start and year_end: the market's years, those of the sheet where it has any.
    """
    key = [compact_key(F.col(c)).alias(f"_{c}") for c in NAME]
    on = ["_make", "_model"]
    n = F.count(F.lit(1))
    asked = asks.withColumns({f"_{c}": compact_key(F.col(c)) for c in NAME})
    known = vehicles.select(*key).distinct().withColumn("_known", F.lit(True))
    seen = scans.select(*key).groupBy(*on).agg(n.alias("scan_count"))
    priced = market.select(*key, "year", "sample_count").groupBy(*on).agg(F.sum("sample_count").alias("market_samples"), F.min("year").alias("_low"), F.max("year").alias("_high"))
    listed = sheet.select(*key, "year_from", "year_to").groupBy(*on).agg(n.alias("csv_specs"), F.min("year_from").alias("_from"), F.max("year_to").alias("_to"))
    found = asked
    for part in (known, seen, priced, listed):
        found = found.join(part, on, "left")
    found = found.na.fill(0, ["scan_count", "market_samples", "csv_specs"])
    in_sheet = F.col("csv_specs") > 0

    def reason() -> Column:
        out = F.when(is_generic_model(F.col("model"), F.col("make")), "generic").when(F.col("_known"), "known")
        out = out.when(F.col("scan_count") < F.when(in_sheet, 0).otherwise(LEAST_SCANS), "scans")
        return out.when(~in_sheet & (F.col("market_samples") < LEAST_SAMPLES), "samples").otherwise("eligible")

    years = {"year_start": F.coalesce("_from", "_low"), "year_end": F.coalesce("_to", "_high")}
    found = found.withColumn("reason", reason())
    return found.select(*asks.columns, "reason", (F.col("reason") == "eligible").alias("eligible"), "scan_count", "market_samples", "csv_specs", *[F.when(F.col("reason") == "eligible", y).alias(k) for k, y in years.items()])
