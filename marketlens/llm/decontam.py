"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become word templates: numbers, names and units are typed placeholders, other words their
lower-cased selves. Both are cut in windows of five template words and joined by the windows' hashes.

1. Items: every distinct window with its place and the values in its slots, one row each.
2. Documents: one pass cuts every text and keeps the windows that a bitmap of the benchmark's hashes has (8 MB for any
   benchmark; what it lets through wrongly costs a row, no result), with their slots' values.
3. Candidates: a document that has at least 75 % of an item's n windows has one of any n - ceil(0.75 n) + 1 of them, so
   the documents' windows are joined to as many of each item's rarest windows, and to no others. This loses nothing.
4. Check: all windows of a candidate pair are joined. The document is contaminated if they cover 75 % of the item and,
   along each alignment, places of the item that hold one and the same value hold one in the document too (a quarter of
   them may differ), so a question with other numbers or names is caught and a mere likeness is not.

Defined cases: null and empty texts and items have no words and match nothing; a text or item of fewer than five template
words is one window of its own; repeated items count once each; a document that holds several items reports the smallest
item of the best coverage (null last); an empty benchmark leaves all documents clean; ids may be of any type, null or
repeated, as documents are told apart by row; an input column ``leak`` is replaced, other columns pass through unread.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, SIEVE_BITS, bitmap, by_batches, chained, in_bitmap, load, mixed64, settled, with_rows, without

#: Template words of a window, and the share of an item's windows, in hundredths, that contaminates.
WORDS, LEAST = 5, 75
#: Distinct words that a task remembers before it starts anew.
MEMORY = 300_000
#: Share of repeated slots that may disagree.
MOST_BROKEN = 0.25
TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|[.!?\n]")
# Units of measure and currencies.
UNITS = frozenset("mm cm m km kg g mg lb lbs oz l ml s sec min h hour hours minute minutes second seconds day days week weeks month months year years mile miles meter meters metre metres foot feet inch inches dollar dollars euro euros cent cents pound pounds percent degree degrees kmh mph".split())
NUMBER, NAME, UNIT = (np.uint64(xxhash.xxh3_64_intdigest(x) & ~7) for x in (b"<number>", b"<name>", b"<unit>"))
#: Flags in a remembered word's low bits.
CAPITAL, STOP, MEASURE = np.uint64(1), np.uint64(2), np.uint64(4)


class Memory(dict):
    """Token -> hash of its lower-cased form, with flags in the low three bits; a full memory forgets all."""

    def __missing__(self, token: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        if token in ".!?\n":
            value = int(STOP)
        elif token[0].isdigit():
            value = int(NUMBER)
        else:
            low = token.lower()
            value = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~7
            value |= int(CAPITAL) * (len(token) > 1 and token[0] != low[0] and token[1:] == low[1:]) | int(MEASURE) * (low in UNITS)
        self[token] = value
        return value


def template(text: str | None, memory: Memory) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Template words (hashes), the token each one starts at, and the tokens."""
    tokens = TOKEN.findall(text or "")
    raw = np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens))
    flags, words = raw & np.uint64(7), raw & ~np.uint64(7)
    stop = (flags & STOP) > 0
    after_stop = np.r_[True, stop[:-1]]
    number = words == NUMBER
    words = np.where(((flags & MEASURE) > 0) & np.r_[False, number[:-1]], UNIT, words)
    words = np.where(((flags & CAPITAL) > 0) & ~after_stop, NAME, words)
    keep = ~stop & ~((words == NAME) & np.r_[False, words[:-1] == NAME])  # a name of several words is one place
    return words[keep], np.flatnonzero(keep), tokens


def windows(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        return chained([words[i : len(words) - n + 1 + i] for i in range(n)])


def slot_value(words: np.ndarray, at: np.ndarray, tokens: list[str], i: int) -> str | None:
    """What stands in place i if it is a placeholder: a number, a unit, or a name's words."""
    if words[i] not in (NUMBER, NAME, UNIT):
        return None
    end = at[i + 1] if i + 1 < len(at) else len(tokens)
    return " ".join(t.lower() for t in tokens[at[i] : end] if t not in ".!?\n") if words[i] == NAME else tokens[at[i]].lower()


def slot_values(words: np.ndarray, at: np.ndarray, tokens: list[str], first: int) -> list[str | None]:
    """The values in the slots of the window that begins at first; null where no slot is."""
    return [slot_value(words, at, tokens, i) for i in range(first, min(first + WORDS, len(words)))]


ITEM = "item long, size int, place int, hash long, slots array<string>"


def _item_windows(batches):
    """Of (item, text): each distinct window of an item with its first place, and how many the item has."""
    memory = Memory()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, at, tokens = template(text, memory)
            own, first = np.unique(windows(words), return_index=True)
            rows += [(item, len(own), int(i), int(h), slot_values(words, at, tokens, int(i))) for h, i in zip(own.view(np.int64), first, strict=True)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "size", "place", "hash", "slots"])


def sieve_place(hashes: np.ndarray) -> np.ndarray:
    return (mixed64(hashes) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def hits_of(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(FILE, ROW, hash, at, values) of the windows of every text that the bitmap has."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def cut(batches):
        memory, bits = Memory(), shared.value
        for batch in batches:
            owner, hashes, places, values = [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                words, at, tokens = template(text, memory)
                own = windows(words)
                with np.errstate(over="ignore"):
                    found = np.flatnonzero(in_bitmap(bits, sieve_place(own))) if len(own) else own
                owner += [row] * len(found)
                hashes += own[found].view(np.int64).tolist() if len(found) else []
                places += found.tolist()
                values += [slot_values(words, at, tokens, int(i)) for i in found]
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(values, pa.list_(pa.string()))], [FILE, ROW, "hash", "at", "values"])

    return docs.select(FILE, ROW, "text").mapInArrow(cut, f"{FILE} long, {ROW} long, hash long, at int, values array<string>")


def _marks(batches):
    """The places in the bitmap of a column of hashes."""
    for batch in batches:
        with np.errstate(over="ignore"):
            yield pa.RecordBatch.from_arrays([pa.array(sieve_place(batch.column(0).to_numpy().view(np.uint64)))], ["at"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(FILE, ROW, n_items, best_item, coverage) of the rows of docs, which has FILE and ROW, that hold benchmark items."""
    by_batches(docs.sparkSession)
    items = settled(benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    parts = settled(items.select("item", "text").mapInArrow(_item_windows, ITEM), "item-windows")
    marks = bitmap(parts.select("hash").mapInArrow(_marks, "at long"), "at")
    hits = settled(hits_of(docs, marks), "window-hits")
    row = [FILE, ROW]
    seen = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("seen"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("seen", F.lit(0)), "hash")
    spare = F.col("size") - F.ceil(F.col("size") * LEAST / 100) + 1
    asked = parts.join(seen, "hash", "left").withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= spare)
    candidates = hits.select(*row, "hash").join(asked.select("hash", "item"), "hash").select(*row, "item").distinct()
    pairs = candidates.join(parts, "item").join(hits, [*row, "hash"])
    pairs = settled(pairs.select(*row, "item", "size", "place", "at", "slots", "values"), "candidates")
    covered = pairs.groupBy(*row, "item").agg(F.countDistinct("place").alias("n"), F.max("size").alias("size")).where(F.col("n") * 100 >= F.col("size") * LEAST)
    # Each slot's value in the item and in the document, by alignment; a slot stands in up to five windows.
    slot = pairs.select(*row, "item", "at", (F.col("at") - F.col("place")).alias("shift"), F.posexplode(F.arrays_zip("slots", "values")).alias("j", "x")).where("x.slots is not null")
    slot = slot.select(*row, "item", "shift", F.col("x.slots").alias("value"), (F.col("at") + F.col("j")).alias("place"), F.col("x.values").alias("found")).distinct()
    same = slot.groupBy(*row, "item", "shift", "value").agg(F.count(F.lit(1)).alias("places"), (F.count_distinct(F.coalesce("found", F.lit(""))) > 1).cast("int").alias("broken")).where("places > 1")
    broken = same.groupBy(*row, "item").agg(F.sum("broken").alias("broken"), F.count(F.lit(1)).alias("repeated"))
    whole = covered.join(broken, [*row, "item"], "left").where(F.coalesce(F.col("broken") <= F.col("repeated") * MOST_BROKEN, F.lit(True)))
    best = F.struct((-F.col("n") / F.col("size")).alias("missing"), F.col("item_id").isNull().alias("nameless"), "item_id")
    found = whole.join(items.select("item", "item_id"), "item").groupBy(*row).agg(F.count(F.lit(1)).alias("n_items"), F.min(best).alias("best"))
    return found.select(*row, "n_items", F.col("best.item_id").alias("best_item"), (-F.col("best.missing")).alias("coverage"))


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the column leak: struct of n_items, best_item and coverage (0, null and 0.0 for clean documents)."""
    rows = with_rows(docs)
    found = leaks(rows, benchmark)
    leak = F.struct(F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("best_item"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    kept = [c for c in docs.columns if c != "leak"]
    own = found.select(FILE, ROW, leak.alias("leak"))
    clean = F.struct(F.lit(0).cast("long").alias("n_items"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("best_item"), F.lit(0.0).alias("coverage"))
    return rows.select(*kept, FILE, ROW).join(own, [FILE, ROW], "left").select(*kept, F.coalesce("leak", clean).alias("leak"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    rows = with_rows(docs)
    return without(rows, settled(leaks(rows, benchmark).select(FILE, ROW), "leaks"), [FILE, ROW]).select(*docs.columns)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    rows = with_rows(load(spark, sf_dir, "documents"))
    found = leaks(rows, load(spark, sf_dir, "benchmark"))
    n = F.coalesce("n_items", F.lit(0)).cast("long")
    return rows.select("doc_id", FILE, ROW).join(found, [FILE, ROW], "left").select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "best_item", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
