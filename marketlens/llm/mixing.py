"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is shuffled by a hash of its id and text and laid end to end with its source, up to three times
over (epochs). Its virtual finish time is the source's cumulative words divided by the source's weight. The documents
of all sources are put in one order by finish time (a global range sort) and cut where the running sum of words passes
the budget. Sources that run dry leave their share to the others, which is what weighted fair queueing does by itself.

Running sums never gather a source, or the whole table, in one task: rows go to slots (of a source by hash range, of
the whole by virtual time), slots are summed, the few sums are accumulated, and rows add their slot's offset.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows that repeat an id are
documents of their own, ordered within the source by (hash of id and text, id), and fully equal rows are interchangeable;
a null id sorts last; an empty table gives an empty result; documents of size 0 are taken 0 words; sources of equal ratio
of cap to weight are filled in the order of their names, which changes no target. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, plain_word_count, settled, with_rows

#: Weights by place in the order of sources, and how often a document may be repeated.
CYCLE = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Rows that one slot of a source should hold, and words that one slot of virtual time should hold.
SLOT_ROWS = 10_000


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Give each row of (source, source_size, ...) the column weight: by code point, null last, the cycle repeating.

    One row per source: the window over all of them holds a table of sources, not of documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", pick)


def targets(sources: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Add target and level to (source, source_size, weight): shares of the total, stopped at most_repeats times the size.

    Sorted by cap/weight, the capped sources are a prefix; the level is what the rest get for one unit of weight.
    """
    cap = F.col("source_size") * F.lit(float(most_repeats))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sources.withColumn("ratio", cap / F.col("weight")).withColumns(
        {
            "left_words": F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The first source whose cap is not below the level that holds from it on sets the level; equal ratios go by place.
    ranked = ranked.withColumn("at", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("ratio") >= F.col("left_words") / F.col("left_weight"), F.struct("at", "left_words", "left_weight"))).over(everything)
    ranked = ranked.withColumn("first", level).withColumn("level", F.coalesce(F.col("first.left_words") / F.col("first.left_weight"), F.lit(0.0)))
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.col("level"))).select("source", "source_size", "weight", "target", "level")


def mix(docs: DataFrame, weigh=cyclic_weights, most_repeats: int = MOST_REPEATS, slot_rows: int = SLOT_ROWS, size: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, weight, target, taken) for every row of docs, which has doc_id, text, source.

    The columns keep, which must tell rows apart, are returned too.
    """
    size = plain_word_count(F.col("text")) if size is None else size
    own = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    # Texts are read once; all else works on this table of numbers.
    slim = settled(docs.select("doc_id", "source", size.alias("size"), F.md5(own.cast("binary")).alias("place"), *keep), "sizes")
    known = slim.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    slots = max(1, -(-known["rows"] // slot_rows))
    budget = int(known["words"])
    slim = slim.withColumn("slot", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.lit(slots) / F.lit(2**32)))

    # Words before each slot of its source, and the sources' targets: tables of slots and of sources.
    sums = slim.groupBy("source", "slot").agg(F.sum("size").alias("slot_words"))
    sources = targets(weigh(sums.groupBy("source").agg(F.sum("slot_words").alias("source_size"))), most_repeats)
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("slot").alias("k"), F.coalesce(F.sum("slot_words").over(ahead), F.lit(0)).alias("ahead"))
    offsets = offsets.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    upto = Window.partitionBy("source", "slot").orderBy(F.col("place"), F.col("doc_id").asc_nulls_last(), *keep).rowsBetween(Window.unboundedPreceding, 0)
    lone = slim.withColumns({"upto": F.sum("size").over(upto), "row": F.row_number().over(upto)})
    placed = lone.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).drop("s", "k")

    # One row per document and epoch, with its finish time; virtual time is cut in spans of about equally many words.
    epochs = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))))
    finish = (F.col("epoch") * F.col("source_size") + F.col("ahead") + F.col("upto")) / F.col("weight")
    queue = epochs.where(F.col("size") > 0).select("doc_id", "source", "slot", "row", "size", "level", finish.alias("finish"), "epoch")
    spans = max(1, -(-known["rows"] // slot_rows))
    queue = queue.withColumn("span", F.floor(F.col("finish") / F.col("level") * F.lit(spans)))
    words = queue.groupBy("span").agg(F.sum("size").alias("span_words"))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = words.select(F.col("span").alias("k"), F.coalesce(F.sum("span_words").over(earlier), F.lit(0)).alias("earlier"))
    running = Window.partitionBy("span").orderBy(F.col("finish"), F.col("source").asc_nulls_last(), F.col("epoch"), F.col("slot"), F.col("row")).rowsBetween(Window.unboundedPreceding, 0)
    sorted_queue = queue.withColumn("so_far", F.sum("size").over(running)).join(starts, F.col("span") == F.col("k"))
    taken = sorted_queue.where(F.col("earlier") + F.col("so_far") <= F.lit(budget)).groupBy(F.col("source").alias("s"), F.col("slot").alias("k"), F.col("row").alias("r")).agg(F.sum("size").alias("words"))
    found = placed.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k")) & (F.col("row") == F.col("r")), "left")
    return found.select("doc_id", "source", "size", "source_size", "weight", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), *keep)


def taken_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, null and repeated ids included, with size, source_size, target and taken.

    Input columns of these four names are replaced.
    """
    rows = with_rows(docs)
    new = ("size", "source_size", "target", "taken")
    found = mix(rows, keep=(FILE, ROW)).where("taken > 0").select(FILE, ROW, "size", "source_size", F.round("target", 4).alias("target"), "taken")
    kept = [c for c in docs.columns if c not in new]
    return rows.select(*kept, FILE, ROW).join(found, [FILE, ROW]).select(*kept, *new)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import load

    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
step AS (
  -- Words that all sources take where each gets r for one unit of weight, but no more than three times its size.
  SELECT r.ratio, sum(least(s.source_size * 3.0::DOUBLE, s.weight * r.ratio)) AS filled
  FROM (SELECT DISTINCT source_size * 3.0::DOUBLE / weight AS ratio FROM src) r, src s GROUP BY r.ratio),
full_at AS (
  SELECT coalesce(max(ratio), -1) AS ratio FROM step WHERE filled < (SELECT sum(source_size) FROM src)),
lev AS (
  SELECT ((SELECT sum(source_size) FROM src) - coalesce(sum(source_size * 3.0::DOUBLE) FILTER (WHERE source_size * 3.0::DOUBLE / weight <= f.ratio), 0))
         / sum(weight) FILTER (WHERE source_size * 3.0::DOUBLE / weight > f.ratio) AS level
  FROM src, full_at f),
tgt AS (
  SELECT source, source_size, weight, least(source_size * 3.0::DOUBLE, weight * coalesce(level, 0)) AS target FROM src, lev),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.weight, t.target,
         (sum(s.size) OVER w)::BIGINT AS upto, row_number() OVER w AS row
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source
  WINDOW w AS (PARTITION BY s.source ORDER BY s.place, s.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
queue AS (
  SELECT p.*, e.epoch, (e.epoch * source_size + upto)::DOUBLE / weight AS finish
  FROM placed p, (SELECT unnest([0, 1, 2]) AS epoch) e WHERE size > 0),
run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM queue),
got AS (
  SELECT source, row, sum(size)::BIGINT AS words FROM run WHERE so_far <= (SELECT sum(size) FROM sized) GROUP BY source, row)
SELECT p.doc_id, p.size, p.source_size, round(p.target, 4) AS target, coalesce(g.words, 0)::BIGINT AS taken
FROM placed p LEFT JOIN got g ON p.source IS NOT DISTINCT FROM g.source AND p.row = g.row
"""
