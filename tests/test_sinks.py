"""Published versions, run logs and log records."""

import logging

import pytest
from pyspark.sql import functions as F

from marketlens.sinks import publish, runs


def test_versions(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    a, none = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([], "k int")
    with pytest.raises(publish.PublishError):
        publish.manifest(spark, base)
    first = publish.publish({"a": a, "none": none}, base, " v 1 / beta ", required=("a",))
    assert first["version"] == "v-1-beta" and first["tables"]["a"]["rows"] == 3 and first["tables"]["none"]["rows"] == 0 and first["tables"]["a"]["bytes"] > 0
    second = publish.publish({"a": a.repartition(3).orderBy("v")}, base, "2")
    assert second["tables"]["a"]["checksum"] == first["tables"]["a"]["checksum"] and second["number"] == 2
    assert publish.publish({"a": a.distinct()}, base, "3")["tables"]["a"]["checksum"] != first["tables"]["a"]["checksum"]
    assert publish.table(spark, base, "a").count() == 2 and publish.table(spark, base, "none", 1).columns == ["k"]
    with pytest.raises(KeyError):
        publish.table(spark, base, "none")
    assert publish.roll_back(spark, base, 1)["number"] == 4 and publish.table(spark, base, "a").count() == 3
    assert len(publish.clean(spark, base, keep=2)) == 1 and publish.table(spark, base, "a").count() == 3 and publish.table(spark, base, "a", 3).count() == 2


def test_nothing_is_seen_before_it_is_valid(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    a, none = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "k int")
    for tables, required in (({"a": a}, ("b",)), ({"a": a, "b": none}, ("b",))):
        with pytest.raises(publish.PublishError):
            publish.publish(tables, base, "x", required)
    assert publish.numbers(spark, base) == []
    with pytest.raises(ValueError):
        publish.publish({"a": a}, base, " /// ")
    entry = publish.publish({"a": a}, base, "x")["tables"]["a"]
    a.write.mode("append").parquet(entry["path"])
    with pytest.raises(publish.PublishError):
        publish.validate(spark, entry)
    with pytest.raises(publish.PublishError):
        publish.roll_back(spark, base, 1)
    with pytest.raises(publish.PublishError):  # another publisher took the number
        publish._write_text(spark, f"{base}/manifests/00000001.json", "{}")
    assert publish.manifest(spark, base)["version"] == "x"


def test_runs(spark, tmp_path):
    path = f"{tmp_path}/runs"
    with runs.tracked(spark, path, "good") as run:
        run.observe(spark.range(5)).write.format("noop").mode("overwrite").save()
        run.observe(spark.range(2)).write.format("noop").mode("overwrite").save()
    with runs.tracked(spark, path, "plain") as run:
        run.count = 42
    with pytest.raises(KeyError), runs.tracked(spark, path, "bad"):
        raise KeyError("k")
    got = {r["name"]: (r["status"], r["count"], r["error"], r["began"] <= r["at"]) for r in runs.runs(spark, path).collect()}
    assert got == {"good": ("success", 7, None, True), "plain": ("success", 42, None, True), "bad": ("failure", None, "KeyError: 'k'", True)}
    dying = runs.tracked(spark, path, "dying")
    dying.__enter__()
    assert runs.runs(spark, path).where("name = 'dying'").first()["status"] == "running"


def test_log_records(spark, tmp_path, capsys):
    path, log = f"{tmp_path}/logs", logging.getLogger("marketlens.test")
    handler = runs.TableHandler(spark, path, most=2)
    log.addHandler(handler)
    try:
        log.info("too quiet")
        log.warning("first %d", 1, extra={"ad_id": 7, "when": object})
        log.error("second")
        log.warning("third")
        logging.getLogger("py4j.x").warning("own")
        handler.flush()
    finally:
        log.removeHandler(handler)
    rows = {r["message"]: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {"first 1", "second", "third"} and rows["second"]["level"] == "ERROR" and rows["second"]["extra"] is None
    assert spark.range(1).select(F.get_json_object(F.lit(rows["first 1"]["extra"]), "$.ad_id")).first()[0] == "7"
    handler.path = "nosuchscheme://x/y"
    handler.held = [("ERROR", "m", "lost", None, rows["third"]["at"])]
    handler.flush()
    assert "lost" in capsys.readouterr().err
