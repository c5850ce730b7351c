"""Publishing a set of tables as one version, in two phases, on any store that Hadoop reads.

1. Each table is written to a folder of its own; rows and a checksum are observed while it is written.
2. The files are read again and must give the same rows and checksum; required tables must not be empty.
3. A manifest with paths, rows, checksums, sizes and schemas is written aside and renamed to the next number. The rename
   fails where that number is taken, so of two publishers one gets an error and readers see whole versions only.

A checksum is the sum of the rows' 64-bit hashes, so neither order nor partitioning matters, and repeated rows count.
Nothing is changed in place: a reader that holds a manifest keeps its files until clean() removes old versions.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class PublishError(Exception):
    """A version that does not hold what it should, or that another publisher was faster to write."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write aside, then rename; a file that exists already is an error."""
    fs, at = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.mkdirs(at.getParent())
    # Rename without the option to overwrite, which local stores otherwise do.
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, at, options)
    except Exception as error:  # the JVM's, whose class depends on the store
        fs.delete(aside, False)
        raise PublishError(f"{path} was written meanwhile") from error


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def slug_of(version: str) -> str:
    slug = re.sub(r"-+", "-", re.sub(r"[^a-zA-Z0-9._-]+", "-", version.strip())).strip("-._")
    if not slug:
        raise ValueError("a version needs letters or digits")
    return slug


def _sums(df: DataFrame) -> list[Column]:
    row = F.xxhash64(*[F.to_json(c) if df.schema[c].dataType.simpleString().startswith(("map", "variant")) else F.col(c) for c in df.columns])
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum")]


def numbers(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the published manifests, ascending."""
    fs, at = _fs(spark, f"{base}/manifests")
    if not fs.exists(at):
        return []
    return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(at) if re.fullmatch(r"\d{8}\.json", x.getPath().getName()))


def manifest(spark: SparkSession, base: str, number: int | None = None) -> dict:
    """A published manifest, the last one unless a number is given."""
    known = numbers(spark, base)
    if not known or number not in (None, *known):
        raise PublishError(f"nothing published as {number or 'a version'} in {base}")
    return json.loads(_read_text(spark, f"{base}/manifests/{number or known[-1]:08d}.json"))


def validate(spark: SparkSession, entry: dict) -> None:
    """Raise unless a table's files give the rows and the checksum of its manifest entry."""
    try:
        df = spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"])
        found = df.agg(*_sums(df)).first().asDict()
    except PySparkException as error:
        raise PublishError(f"{entry['path']} cannot be read") from error
    said = {k: entry[k] for k in found}
    if found != said:
        raise PublishError(f"{entry['path']} has {found}, its manifest says {said}")


def publish(tables: dict[str, DataFrame], base: str, version: str, required: tuple[str, ...] = ()) -> dict:
    """Write tables as one version and return its manifest; nothing is visible before all of them are validated."""
    spark = next(iter(tables.values())).sparkSession
    missing = [name for name in required if name not in tables]
    if missing:
        raise PublishError(f"missing tables: {', '.join(missing)}")
    number = (numbers(spark, base) or [0])[-1] + 1
    folder = f"{base}/versions/{slug_of(version)}-{uuid.uuid4().hex[:12]}"
    entries = {}
    for name, df in tables.items():
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        path = f"{folder}/{name}"
        df.observe(seen, *_sums(df)).write.parquet(path)
        fs, at = _fs(spark, path)
        summary = fs.getContentSummary(at)
        entries[name] = {"path": path, **seen.get, "bytes": summary.getLength(), "files": summary.getFileCount(), "schema": json.loads(df.schema.json())}
        validate(spark, entries[name])
        if name in required and not entries[name]["rows"]:
            raise PublishError(f"{name} is empty")
    found = {"number": number, "version": slug_of(version), "created_at": datetime.now(UTC).isoformat(), "tables": entries}
    _write_text(spark, f"{base}/manifests/{number:08d}.json", json.dumps(found, indent=1))
    return found


def table(spark: SparkSession, base: str, name: str, number: int | None = None) -> DataFrame:
    """A table of a published version, the last one unless a number is given."""
    entry = manifest(spark, base, number)["tables"][name]
    return spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"])


def roll_back(spark: SparkSession, base: str, number: int) -> dict:
    """Make an earlier version the last one again, by a manifest of its own, once its files are validated."""
    old = manifest(spark, base, number)
    for entry in old["tables"].values():
        validate(spark, entry)
    new = old | {"number": numbers(spark, base)[-1] + 1, "rolled_back_to": number}
    _write_text(spark, f"{base}/manifests/{new['number']:08d}.json", json.dumps(new, indent=1))
    return new


def clean(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Remove the folders of versions that none of the last ``keep`` manifests names, and return their paths."""
    fs, at = _fs(spark, f"{base}/versions")
    named = {e["path"].rsplit("/", 2)[1] for n in numbers(spark, base)[-keep:] for e in manifest(spark, base, n)["tables"].values()}
    gone = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName() not in named]
    for path in gone:
        fs.delete(path, True)
    return [p.toString() for p in gone]
