"""Runs of pipelines and log records as tables that only grow.

A run writes a row when it begins and one when it ends, so a run that died stays visible as running; runs() shows the last
row of each. Counts come from observations of the frames that the run writes, not from a second pass. Log records are
kept until a number of them, or the end, makes one small file; a record that cannot be written never raises.
"""

from __future__ import annotations

import json
import logging
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import first_by

RUN = "run_id string, step int, name string, status string, count long, error string, at timestamp"
RECORD = "level string, module string, message string, extra string, at timestamp"
#: What every log record has; the rest is what a caller added.
PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class Run:
    """A run in progress: set count, or observe() the frames that it writes."""

    def __init__(self, name: str):
        self.run_id, self.name, self.count = uuid.uuid4().hex, name, None
        self._seen: list[Observation] = []

    def observe(self, df: DataFrame) -> DataFrame:
        """df, whose rows count towards the run once it has been written."""
        self._seen.append(Observation(uuid.uuid4().hex))
        return df.observe(self._seen[-1], F.count(F.lit(1)).alias("rows"))

    def total(self) -> int | None:
        return self.count if self.count is not None or not self._seen else sum(o.get["rows"] for o in self._seen)


@contextmanager
def tracked(spark: SparkSession, path: str, name: str) -> Iterator[Run]:
    """Log a run of ``name`` in the table at path; an exception is logged as a failure and raised again."""
    run = Run(name)

    def log(step: int, status: str, count: int | None = None, error: str | None = None):
        spark.createDataFrame([(run.run_id, step, name, status, count, error, datetime.now(UTC))], RUN).coalesce(1).write.mode("append").parquet(path)

    log(0, "running")
    try:
        yield run
    except Exception as error:
        log(1, "failure", run.count, f"{type(error).__name__}: {error}"[:2000])
        raise
    log(1, "success", run.total())


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each run, with when it began."""
    rows = spark.read.schema(RUN).parquet(path)
    began = rows.where("step = 0").select("run_id", F.col("at").alias("began"))
    return first_by(rows, ["run_id"], F.desc("step")).drop("step").join(began, "run_id", "left")


class TableHandler(logging.Handler):
    """Appends records of WARNING and above to a table; what a caller passed as ``extra`` is kept as JSON."""

    def __init__(self, spark: SparkSession, path: str, level: int = logging.WARNING, most: int = 100):
        super().__init__(level)
        self.spark, self.path, self.most, self.held = spark, path, most, []

    def emit(self, record: logging.LogRecord) -> None:
        if record.name.startswith(("py4j", "pyspark", __name__)):
            return  # writing a record logs by these names
        try:
            extra = {k: v for k, v in vars(record).items() if k not in PLAIN and not k.startswith("_")}
            self.held.append((record.levelname, record.name, self.format(record) if self.formatter else record.getMessage(), json.dumps(extra, default=str, sort_keys=True) if extra else None, datetime.fromtimestamp(record.created, UTC)))
        except (TypeError, ValueError) as error:
            print(f"log record lost: {error}", file=sys.stderr)
        if len(self.held) >= self.most:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.held = self.held, []
            if not rows:
                return
            try:
                self.spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(self.path)
            except (OSError, PySparkException, Py4JError) as error:
                print(f"{len(rows)} log records lost: {error}", file=sys.stderr)

    def close(self) -> None:
        self.flush()
        super().close()
