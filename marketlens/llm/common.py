"""What the operators share: the shared folder, settled tables, word rules and column helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: one word of the plain word rule; its separators are space and the control characters 9 to 13.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch: texts may be long, and a batch is held in memory by the JVM and by the Python worker.
BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
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
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Columns that tell rows apart where ids repeat or are null; a table that has both keeps them.
FILE, ROW = "__row_file", "__row_place"
#: Bits of a sieve, and of one of its words.
SIEVE_BITS, WORD_BITS = 26, 6


def with_rows(df: DataFrame) -> DataFrame:
    """df with FILE and ROW, which stay the same however often df is computed.

    Rows of files are known by file and place there; any other table is written to the shared folder first.
    """
    if FILE in df.columns and ROW in df.columns:
        return df
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        return settled(df.withColumns({FILE: F.lit(0).cast("long"), ROW: F.monotonically_increasing_id()}), "rows")


def _place(place: Column) -> tuple[Column, Column]:
    """Word and bit of a place of the bitmap."""
    return F.shiftright(place, WORD_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND((1 << WORD_BITS) - 1).cast("int"))


def _marked(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows with __marked: whether a bitmap of the hashes of keys, of 2**20 words at most, has the row's columns ``on``."""
    word, bit = _place(F.shiftrightunsigned(F.xxhash64(*on), 64 - SIEVE_BITS))
    marks = settled(keys.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits")), "sieve")
    held = rows.withColumn("__at", word).join(F.broadcast(marks), F.col("__at") == F.col("__word"), "left")
    return held.withColumn("__marked", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__at", "__word", "__bits")


def bitmap(keys: DataFrame, place: str) -> np.ndarray:
    """The bitmap of places (of SIEVE_BITS bits) as bytes: 8 MB on the driver, whatever the number of rows; see in_bitmap."""
    word, bit = _place(F.col(place))
    found = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << SIEVE_BITS - WORD_BITS, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint8)


def in_bitmap(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether places (of SIEVE_BITS bits) are marked."""
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def sieved(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``rows`` whose columns ``on`` are in keys.

    A bitmap of hashed keys goes first, so that few other rows are shuffled: it is broadcast as at most 2**20 words,
    whatever the number of keys. The join after it is exact.
    """
    held = _marked(rows, keys, on).where("__marked")
    return held.join(keys.select(*on).distinct(), on, "left_semi").select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``rows`` whose columns ``on`` are not in keys; only those that a bitmap of bounded size marks are shuffled."""
    held = _marked(rows, keys, on)
    doubtful = held.where("__marked").join(keys.select(*on).distinct(), on, "left_anti")
    return held.where(~F.col("__marked")).select(*rows.columns).unionByName(doubtful.select(*rows.columns))


def by_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod modulus: the fold of a document; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def plain_word_count(text: Column) -> Column:
    """Number of plain words, long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long"), F.lit(0).cast("long"))


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each row of equally long arrays, by position."""
    out = mixed64(parts[0] + np.uint64(len(parts)))
    for part in parts[1:]:
        out = mixed64(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out
