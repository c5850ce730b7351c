"""Leases and freshness as streams: in one batch, in several, and after a restart from the checkpoint."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketlens.streaming import deadlines


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def stream_of(spark, folder):
    return spark.readStream.schema("job long, kind string, ts timestamp").parquet(folder)


def put(spark, folder, rows):
    spark.createDataFrame([(j, k, at(m)) for j, k, m in rows], "job long, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def found(df):
    return sorted((r["key"], r["at"].strftime("%d %H:%M"), r["status"]) for r in df.collect())


ROWS = [(1, "open", 0), (1, "close", 10), (2, "open", 0), (3, "open", 0), (3, "close", 45), (4, "close", 5), (4, "noise", 6), (5, "open", 0), (5, "open", 20), (5, "close", 40), (9, "open", 300)]
EXPECTED = [
    (1, "01 00:00", "assigned"), (1, "01 00:10", "done"), (2, "01 00:00", "assigned"), (2, "01 00:30", "pending"), (3, "01 00:00", "assigned"), (3, "01 00:30", "pending"),
    (5, "01 00:00", "assigned"), (5, "01 00:20", "assigned"), (5, "01 00:40", "done"), (9, "01 05:00", "assigned"),
]


def test_leases_in_one_batch(spark, tmp_path):
    put(spark, f"{tmp_path}/in", ROWS)
    assert found(deadlines.drained(deadlines.leases(stream_of(spark, f"{tmp_path}/in"), "job", "kind", "ts"), f"{tmp_path}/out")) == EXPECTED


def test_leases_survive_a_restart(spark, tmp_path):
    run = lambda: found(deadlines.drained(deadlines.leases(stream_of(spark, f"{tmp_path}/in"), "job", "kind", "ts"), f"{tmp_path}/out"))
    put(spark, f"{tmp_path}/in", [r for r in ROWS if r[2] < 10])
    assert all(status == "assigned" for _, _, status in run())
    put(spark, f"{tmp_path}/in", [r for r in ROWS if 10 <= r[2] < 300])
    run()
    put(spark, f"{tmp_path}/in", [r for r in ROWS if r[2] >= 300])
    assert run() == EXPECTED


def test_prices_grow_stale(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, None, 0), (1, None, 60), (2, None, 0), (3, None, 4000)])
    got = found(deadlines.drained(deadlines.freshness(stream_of(spark, f"{tmp_path}/in"), "job", "ts"), f"{tmp_path}/out"))
    assert [x for x in got if x[2] == "stale"] == [(1, "02 01:00", "stale"), (2, "02 00:00", "stale")] and len(got) == 6
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_empty_streams(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [])
    assert deadlines.drained(deadlines.leases(stream_of(spark, f"{tmp_path}/in").where(F.lit(True)), "job", "kind", "ts"), f"{tmp_path}/out").count() == 0


class Counted:
    """A handle with one value state that counts the calls of state and timers."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _call(self):
        self.calls += 1

    def exists(self):
        self._call()
        return self.value is not None

    def get(self):
        self._call()
        return self.value

    def update(self, value):
        self._call()
        self.value = value

    def clear(self):
        self._call()
        self.value = None

    def registerTimer(self, at):
        self._call()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._call()
        self.timers.remove(at)


def test_state_is_touched_once_for_a_key(spark):
    handle, leases = Counted(), deadlines.Deadlines(timedelta(milliseconds=5), "assigned", "done", "pending")
    leases.init(handle)
    rows = [{"at": t, "kind": "open" if t % 4 < 3 else "close"} for t in range(1001)]
    out = list(leases.handleInputRows((1,), rows, None))
    assert [r["status"] for r in out].count("done") == 250 and len(out) == 1001
    assert handle.calls <= 4 and handle.value == (1005,) and handle.timers == {1005}
    handle.calls = 0
    assert [r["status"] for r in leases.handleInputRows((1,), [{"at": 1005, "kind": "close"}], None)] == ["pending"]
    assert handle.calls <= 4 and handle.value is None and not handle.timers
