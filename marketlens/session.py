"""Session settings that every job shares, and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(master: str | None = None, name: str = "marketlens", **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back: what several parts of a plan read is worked out once, and its size is known to
    the planner, so that small tables are broadcast without the other side being shuffled first."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compiled(spark: SparkSession) -> None:
    """For plans with many expressions in a row: the JVM never compiles a method of more than 8000 bytes, so a stage whose
    generated code has one is run by its operators, each with its own code in small methods."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
