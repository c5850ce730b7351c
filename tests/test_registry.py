"""Imports row by row against imports by aggregation, and snapshots of small registries."""

import random

from pyspark.sql import functions as F

from marketlens.operators import coverage, factory

VEHICLE = "vehicle_id long, make string, model string, generation string, year_start int, year_end int"
ROW = "line int, make string, model string, generation string, trim string, year_from int, year_to int, extra string"


def imported_by_rows(vehicles, specs, rows):
    """The import as a loop: what is found, widened, created and skipped."""
    table = [dict(zip(("id", "make", "model", "generation", "start", "end"), v, strict=True)) for v in vehicles]
    known = {(v["make"], v["model"], v["generation"] or ""): v for v in table}
    have = {(v, t or "") for v, t in specs}
    done = []
    for line, make, model, generation, trim, start, end, _ in sorted(rows):
        if not (model or "").strip():
            continue
        key = (make, model, generation or "")
        if key not in known:
            other = next((v for v in table if (v["make"], v["model"]) == (make, model)), None)
            if other:
                other["start"] = min([x for x in (other["start"], start) if x], default=None)
                other["end"] = max([x for x in (other["end"], end) if x], default=None)
            else:
                other = {"id": None, "make": make, "model": model, "generation": generation or "", "start": start or None, "end": end or None}
                table.append(other)
            known[key] = other
        owner = known[key]["id"] or (make, model)
        done.append((line, "skipped" if (owner, trim or "") in have else "created"))
        have.add((owner, trim or ""))
    return sorted(((v["id"], v["make"], v["model"], v["generation"], v["start"], v["end"]) for v in table), key=str), done


def test_imports_by_rows(spark):
    for seed in range(3):
        pick = random.Random(seed)
        vehicles = [(i, pick.choice("AB"), pick.choice("xyz"), pick.choice([None, "", "g1", "g2"]), pick.choice([None, 1990, 1995]), pick.choice([None, 2000, 2005])) for i in range(1, 5)]
        specs = [(pick.randint(1, 5), pick.choice([None, "t1", "t2"])) for _ in range(4)]
        rows = [(i, pick.choice("ABC"), pick.choice(["x", "y", "z", " ", None]), pick.choice([None, "g1", "g2", "g3"]), pick.choice([None, "", "t1", "t2", "t3"]), pick.choice([None, 1985, 1992]), pick.choice([None, 2001, 2010]), "e") for i in range(60)]
        after, done = factory.imported(spark.createDataFrame(vehicles, VEHICLE), spark.createDataFrame(specs, "vehicle_id long, trim string"), spark.createDataFrame(rows, ROW))
        table, lines = imported_by_rows(vehicles, specs, rows)
        assert sorted((tuple(r)[:6] for r in after.collect()), key=str) == table
        assert sorted((r["line"], r["disposition"]) for r in done.collect()) == lines
        was = {v[0]: v[4:] for v in vehicles}
        for r in after.collect():
            assert r["disposition"] == ("created" if r["vehicle_id"] is None else "kept" if was[r["vehicle_id"]] == (r["year_start"], r["year_end"]) else "widened")


def test_empty_imports(spark):
    v, s, r = spark.createDataFrame([], VEHICLE), spark.createDataFrame([], "vehicle_id long, trim string"), spark.createDataFrame([(1, "A", "x", None, None, None, None, "e")], ROW)
    after, done = factory.imported(v, s, r)
    assert [tuple(x) for x in after.collect()] == [(None, "A", "x", "", None, None, "created")] and [x["disposition"] for x in done.collect()] == ["created"]
    assert factory.imported(v, s, r.limit(0))[0].count() == 0


def test_candidates(spark):
    names = "make string, model string"
    of = lambda rows, more="": spark.createDataFrame(rows, names + more)
    asks = of([("A", "Known"), ("A", "Few"), ("A", "Thin"), ("A", "Good"), ("A", "Sheet"), ("audi", "Allroad"), (None, None)])
    scans = of([("a", x) for x in ("thin", "good") for _ in range(3)] + [("a", "few")] * 2)
    market = of([("A", "good", 1999, 15), ("A", "GOOD", 2003, 5), ("A", "thin", 1999, 19), ("A", "sheet", 1990, 1)], ", year int, sample_count int")
    sheet = of([("A", "Sheet", 1980, None), ("A", "Sheet", 1985, None)], ", year_from int, year_to int")
    found = {r["model"]: (r["reason"], r["year_start"], r["year_end"]) for r in factory.candidates(asks, of([("a", "KNOWN")]), scans, market, sheet).collect()}
    assert found == {"Known": ("known", None, None), "Few": ("scans", None, None), "Thin": ("samples", None, None), "Good": ("eligible", 1999, 2003), "Sheet": ("eligible", 1980, 1990), "Allroad": ("generic", None, None), None: ("scans", None, None)}


def test_snapshot(spark):
    vehicles = spark.createDataFrame([(1, True, True, 20), (2, None, False, 20), (3, True, True, 20)], "key long, has_tokens boolean, has_slugs boolean, least_samples int")
    frame = lambda rows, schema: spark.createDataFrame(rows, "key long" + schema)
    market = frame([(1, "FR", 19, False, "2000-01-01"), (1, "CH", 10, True, "2002-01-01"), (3, None, 19, None, None), (3, "CH", 9, None, None), (9, "FR", 1, None, None), (None, "FR", 1, None, None)], ", country string, sample_count int, has_estimate boolean, refresh_after string").withColumn("refresh_after", F.col("refresh_after").cast("timestamp_ntz"))
    scans = frame([(1, "s", "2001-12-30"), (1, "s", "2001-12-10"), (3, "s", None)], ", source string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    now = F.lit("2001-12-31").cast("timestamp_ntz")
    rows = coverage.snapshot(vehicles, now, frame([(1, "b", 90), (1, "a", None), (1, "b", 120)], ", fuel string, hp int"), frame([(1,)], ""), market, frame([(1,)], ""), frame([(1, None), (3, 5)], ", transcript_chars int"), frame([(1,)], ""), scans).collect()
    found = {r["key"]: r for r in rows}
    assert sorted(found) == [1, 2, 3]
    assert (found[1]["gaps"], found[1]["status"], found[1]["readiness"], found[1]["fuels"], found[1]["max_hp"]) == ([], "healthy", 100, ["a", "b"], 120)
    assert (found[1]["markets"], found[1]["insufficient"], found[1]["fresh"], found[1]["scans_week"], found[1]["scans_month"]) == (2, 1, 1, 1, 2)
    assert found[2]["gap_count"] == 10 and found[2]["status"] == "critical" and found[2]["readiness"] == 0
    assert found[3]["gaps"] == ["specs", "tires", "weak market", "seed", "estimate"] and found[3]["status"] == "critical"
