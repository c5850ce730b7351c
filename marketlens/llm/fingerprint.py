"""Fingerprints of documents by locally consistent parsing.

A text is a sequence of code points. Each level of the hierarchy turns its sequence into a shorter one:

1. Runs of one symbol become one symbol, so neighbours differ.
2. Deterministic coin tossing: a symbol's label is the place of the lowest bit in which it differs from its left
   neighbour, and that bit. Four rounds bring 64 bits down to labels 0 to 5, and neighbours still differ.
3. A phrase begins at each local maximum of the labels, so it has two to a dozen symbols or so, and its limits depend
   on a few symbols around it alone. Its name is a 64-bit hash of its symbols in order, and the next level's symbol.

Equal substrings are thus cut into equal phrases and get equal names, but for a few symbols at their ends, wherever
they stand. The fingerprint holds the SKETCH smallest hashed names of each of LEVELS (phrases of some 10, 30 and 90 code
points) in hexadecimal, levels parted by "-"; a level with fewer names holds them all. The likeness of two fingerprints
is the share of phrases that they have in common, 2 J / (1 + J) for the estimated Jaccard similarity J, averaged over
the levels.

next_edited pairs every document with the next one in descending order of ids. Rows are dealt into stretches of that
order; the limits are taken from ids and lengths, and the first row of a stretch is also sent to the stretch before it,
so texts are shuffled once, no stretch needs another one, and no order runs through one task.

Defined cases: null text is empty; an empty text has the fingerprint "" and is like empty texts only; a text that shrinks
to one name keeps it on all higher levels; a null id comes last in the order and rows of one id in the reverse order of
their place; a single row is its own next document; an empty table gives an empty result; other columns are ignored.
Memory grows with the longest text (about 60 bytes for each of its code points), which a row holds anyway.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, by_batches, load, mixed64, settled, with_rows

#: Levels whose names are kept, and how many of each.
LEVELS, SKETCH = (2, 3, 4), 32
#: Rounds of coin tossing.
ROUNDS = 4
#: Code points that are parsed at once: many short texts together, a longer text alone.
TOGETHER = 1 << 17
#: Code points of a stretch of documents, and stretches at most (the driver holds the limits).
STRETCH_CHARS, MOST_STRETCHES = 1 << 24, 20_000
STEP, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def labels(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Small labels of the symbols (neighbours of one sequence differ); sequences begin at starts."""
    x = symbols
    for _ in range(ROUNDS):
        one = x.dtype.type(1)
        other = np.empty_like(x)
        other[1:] = x[:-1]
        other[starts] = x[starts] ^ one
        differ = x ^ other
        place = np.bitwise_count((differ & (~differ + one)) - one)  # 0 is passed on as its width, the same everywhere
        x = (place << np.uint8(1)) | ((x >> place.astype(x.dtype)) & one).astype(np.uint8)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k < n at least; kept for the next call."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, x in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                many = np.full(max(n, TOGETHER), x, np.uint64)
                many[0] = 1
                _powers[i] = np.multiply.accumulate(many)
    return _powers[0][:n], _powers[1]


def without_runs(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of one symbol as one symbol of its own. Code points stay 32 bits wide: short runs pack their length above
    the code point, long ones are hashed."""
    changed = np.empty(len(symbols), bool)
    changed[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=changed[1:])
    changed[starts] = True
    at = np.flatnonzero(changed)
    if len(at) == len(symbols):
        return symbols, starts
    length = np.diff(at, append=len(symbols))
    out = symbols[at]
    runs = np.flatnonzero(length > 1)
    what, many = out[runs].astype(np.uint64), length[runs].astype(np.uint64)
    hashed = mixed64(what * STEP + many)
    if out.dtype == np.uint32:
        hashed = np.where(many < np.uint64(1024), what | many << np.uint64(21), hashed >> np.uint64(33) | np.uint64(1 << 31)).astype(np.uint32)
    out[runs] = hashed
    return out, np.searchsorted(at, starts)


def phrases(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's symbols and starts. A sequence of one symbol stays as it is."""
    lone = np.flatnonzero(np.diff(starts, append=len(symbols)) == 1)
    kept = symbols[starts[lone]]
    symbols, starts = without_runs(symbols, starts)
    label = labels(symbols, starts)
    begins = np.zeros(len(symbols), bool)
    rises = label[1:] > label[:-1]
    falls = label[:-1] > label[1:]
    np.logical_and(rises[:-1], falls[1:], out=begins[1:-1])
    begins[starts[1:] - 1] = False  # the neighbour on the right belongs to another text
    begins[starts] = True
    at = np.flatnonzero(begins)
    up, down = powers(len(symbols))
    names = np.add.reduceat(symbols * up, at) * down[at]
    names = mixed64(names ^ np.diff(at, append=len(symbols)).astype(np.uint64) * STEP)
    found = np.searchsorted(at, starts)
    names[found[lone]] = kept
    return names, found


def _sketches(texts: list[str]) -> list[list[np.ndarray]]:
    """For each of LEVELS the sorted sketch of each text; texts are not empty."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *map(len, texts[:-1])])
    out: list[list[np.ndarray]] = []
    symbols = codes
    with np.errstate(over="ignore"):
        for level in range(1, max(LEVELS) + 1):
            symbols, starts = phrases(symbols, starts)
            if level in LEVELS:
                whose = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(starts, append=len(symbols)))
                keys = np.sort((whose << np.uint64(32)) | (mixed64(symbols.astype(np.uint64)) >> np.uint64(32)))
                keys = keys[np.append(True, keys[1:] != keys[:-1])]
                first = np.searchsorted(keys, np.arange(len(texts), dtype=np.uint64) << np.uint64(32))
                hashes = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out.append([hashes[a : min(a + SKETCH, b)] for a, b in zip(first, [*first[1:], len(keys)], strict=True)])
    return out


def sketches(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """The sketch of every level for every text; () for an empty one."""
    out: list[tuple[np.ndarray, ...]] = [()] * len(texts)
    held: list[int] = []
    size = 0

    def parse():
        if held:
            for i, sketch in zip(held, zip(*_sketches([texts[i] for i in held]), strict=True), strict=True):
                out[i] = sketch
            held.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        if size + len(text) > TOGETHER:
            parse()
            size = 0
        held.append(i)
        size += len(text)
    parse()
    return out


def written(sketch: tuple[np.ndarray, ...]) -> str:
    return "-".join(x.astype(">u4").tobytes().hex() for x in sketch)


def read(fingerprint: str) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in fingerprint.split("-")) if fingerprint else ()


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Share of phrases in common, averaged over the levels: 1 for equal texts, 0 for texts that share none."""
    if not a or not b:
        return float(len(a) == len(b))
    total = 0.0
    for x, y in zip(a, b, strict=True):
        p, q = set(x.tolist()), set(y.tolist())
        common = p & q
        if common:
            either = sorted(p | q)[:SKETCH]  # the sketch of both together
            j = len(common.intersection(either)) / len(either)
            total += 2 * j / (1 + j)
    return round(total / len(a), 6)


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as much of the following one's beginning."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_PAIRED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _paired(batches):
    """Of rows (doc_id, text, stretch, tail) in order: every row that is no tail, with the one after it of its stretch."""
    open_row = None  # (doc_id, text, sketch, stretch)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        own = sketches(texts)
        pairs = []
        for doc_id, text, sketch, stretch, tail in zip(batch.column(0), texts, own, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if open_row is not None and open_row[3] == stretch:
                pairs.append((*open_row[:3], edited(open_row[1], text), sketch))
            open_row = None if tail else (doc_id, text, sketch, stretch)
        changed = sketches([p[3] for p in pairs])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0].as_py() for p in pairs], batch.schema.field(0).type),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(p[3].encode()).hexdigest() for p in pairs], pa.string()),
                pa.array([written(p[2]) for p in pairs], pa.string()),
                pa.array([written(c) for c in changed], pa.string()),
                pa.array([likeness(p[2], c) for p, c in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
            ],
            _PAIRED,
        )


def _first(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            break
    for _ in batches:  # the rest must be read for the task to end well
        pass


def next_edited(docs: DataFrame) -> DataFrame:
    """The columns of _PAIRED for every row of docs, which has doc_id and text."""
    spark = docs.sparkSession
    by_batches(spark)
    rows = with_rows(docs.select("doc_id", "text", *[c for c in (FILE, ROW) if c in docs.columns])).select("doc_id", FILE, ROW, "text")
    order = [F.desc_nulls_last("doc_id"), F.desc(FILE), F.desc(ROW)]
    slim = settled(rows.select("doc_id", FILE, ROW, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")), "lengths")
    chars = slim.agg(F.sum("size")).first()[0] or 0
    n = min(MOST_STRETCHES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // STRETCH_CHARS)))
    kind = slim.schema["doc_id"].dataType.simpleString()
    # One row for each stretch: its first one. In reverse order, limits ascend.
    limits = slim.select("doc_id", FILE, ROW).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_first, f"doc_id {kind}, {FILE} long, {ROW} long").collect()

    def key(doc_id, file, row):
        return (0, 0, file, row) if doc_id is None else (1, doc_id, file, row)

    ascending = sorted(key(*x) for x in limits)

    @F.arrow_udf("int")
    def stretch_of(ids: pa.Array, files: pa.Array, places: pa.Array) -> pa.Array:
        """Twice the stretch, and 1 more for its first row."""
        found = []
        for x in map(key, ids.to_pylist(), files.to_pylist(), places.to_pylist()):
            i = bisect_left(ascending, x)
            found.append(2 * (len(ascending) - 1 - i) + (i < len(ascending) and ascending[i] == x))
        return pa.array(found, pa.int32())

    many = max(1, len(ascending))
    at = F.col("__at").bitwiseAND(1) == 1
    own = F.floor(F.col("__at") / 2).cast("int")
    home = F.struct(own.alias("stretch"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(own - 1, F.lit(many)).alias("stretch"), F.lit(True).alias("tail"))
    dealt = rows.withColumn("__at", stretch_of("doc_id", FILE, ROW)).withColumn("__to", F.explode(F.when(at, F.array(home, before)).otherwise(F.array(home))))
    dealt = dealt.select("doc_id", "text", F.col("__to.stretch").alias("stretch"), F.col("__to.tail").alias("tail"), FILE, ROW)
    sorted_rows = dealt.repartitionById(many, F.col("stretch")).sortWithinPartitions("stretch", "tail", *order)
    kinds = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_rows.select("doc_id", "text", "stretch", "tail").mapInArrow(_paired, kinds)


def op12_fingerprint(spark, sf_dir: str) -> DataFrame:
    return next_edited(load(spark, sf_dir, "documents"))
