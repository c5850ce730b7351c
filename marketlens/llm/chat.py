"""Preference formatting: one prompt per pair of conversations, and two masked completions.

Turns of the chosen and the rejected conversation are numbered by their order and joined place by place; the smallest
place where role or text differ ends the longest common prefix. Turns are rendered one by one; only then are a side's
pieces put together in order. The prefix is rendered once, as prompt; each completion has a mask, the character spans
of what assistants say (with their end marks), on which a loss would be taken.

Defined cases: a null role is rendered as `unknown`, a null text as empty, and both equal only null; turns with a null
number come last; equal turn numbers are ordered by role and text, and fully equal rows stay as repeated turns; if one
conversation is a prefix of the other, its completion is empty, without mask; a side without conversation is empty too;
rows with a null conv_id are ignored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load

# The marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns of each conversation numbered from 0 in order."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def preferences(pairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each of pairs (pair_id, chosen_id, rejected_id): prompt, completions and their masks.

    Returns pair_id, prefix_turns, prompt, chosen, chosen_mask, rejected, rejected_mask; a mask is a list of
    `start-end` character spans of its completion, joined by commas.
    """
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("c")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("c")))).alias("x")).select("pair_id", "x.side", "x.c")
    turns = sides.join(numbered(conversations), F.col("c") == F.col("conv_id")).select("pair_id", "side", "place", "role", "text")
    # Both sides' turns of one place meet; a place with one side only differs too.
    both = turns.groupBy("pair_id", "place").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.xxhash64("role", "text", F.col("role").isNull(), F.col("text").isNull())).alias("kinds"))
    prefix = both.groupBy("pair_id").agg(F.coalesce(F.min(F.when((F.col("n") < 2) | (F.col("kinds") > 1), F.col("place"))), F.count(F.lit(1)).cast("int")).alias("prefix_turns"))

    head = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(END))
    pieces = turns.join(prefix, "pair_id").withColumn("part", F.when(F.col("place") < F.col("prefix_turns"), "prompt").otherwise(F.col("side")))
    pieces = pieces.where("part <> 'prompt' or side = 'chosen'").select("pair_id", "prefix_turns", "part", "place", "role", F.concat(head, said, F.lit("\n")).alias("piece"), F.length(head).alias("from"), F.length(said).alias("spoken"))
    before = Window.partitionBy("pair_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("from"))
    span = F.when(F.col("role") == TRAINED_ROLE, F.concat_ws("-", F.col("start").cast("string"), (F.col("start") + F.col("spoken")).cast("string")))

    def joined(part: str, column: str, by: str):
        inside = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("place", F.col(column).alias("x")))))
        return F.array_join(F.transform(inside, lambda s: s["x"]), by)

    found = pieces.withColumn("span", span).groupBy("pair_id").agg(
        joined("prompt", "piece", "").alias("prompt"),
        *[joined(part, column, by).alias(name) for part in ("chosen", "rejected") for column, by, name in (("piece", "", part), ("span", ",", f"{part}_mask"))],
    )
    out = pairs.select("pair_id").join(found, "pair_id", "left").join(prefix, "pair_id", "left")
    empty = {c: F.coalesce(c, F.lit("")) for c in ("prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")}
    return out.withColumns({**empty, "prefix_turns": F.coalesce("prefix_turns", F.lit(0)).cast("long")}).select("pair_id", "prefix_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def with_rejected(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs, and the conversations of both their sides, for a table without judgements.

    Conversation c is chosen as it is; rejected is the same one with its last assistant turn (by order) taken from that of
    conversation c + 1, or without that turn if there is none. Sides are numbered 2c and 2c + 1.
    """
    turns = numbered(conversations)
    last = turns.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("place", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("instead"))
    facts = last.select("conv_id", F.col("last.place").alias("at")).join(other, "conv_id", "left")
    both = turns.join(facts, "conv_id", "left")
    chosen = both.select((F.col("conv_id") * 2).alias("conv_id"), F.col("place").alias("turn"), "role", "text")
    swapped = F.coalesce(F.col("place") == F.col("at"), F.lit(False))
    rejected = both.where(~swapped | F.col("instead").isNotNull()).select((F.col("conv_id") * 2 + 1).alias("conv_id"), F.col("place").alias("turn"), "role", F.when(swapped, F.col("instead")).otherwise(F.col("text")).alias("text"))
    pairs = turns.select("conv_id").distinct().select(F.col("conv_id").alias("pair_id"), (F.col("conv_id") * 2).alias("chosen_id"), (F.col("conv_id") * 2 + 1).alias("rejected_id"))
    return pairs, chosen.unionByName(rejected)


def op7_chat(spark, sf_dir: str) -> DataFrame:
    return preferences(*with_rejected(load(spark, sf_dir, "conversations")))


OP7_SQL = """
WITH o AS (
  SELECT conv_id AS pair_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, max(place) AS at, arg_max(coalesce(text, ''), place) AS said FROM o WHERE role = 'assistant' GROUP BY pair_id),
t AS (
  SELECT pair_id, 'chosen' AS side, role, text, place FROM o
  UNION ALL
  SELECT o.pair_id, 'rejected', o.role, CASE WHEN o.place = l.at THEN n.said ELSE o.text END,
         row_number() OVER (PARTITION BY o.pair_id ORDER BY o.place) - 1
  FROM o LEFT JOIN l ON o.pair_id = l.pair_id LEFT JOIN l n ON n.pair_id = o.pair_id + 1
  WHERE l.at IS NULL OR o.place <> l.at OR n.said IS NOT NULL),
p AS (
  SELECT pair_id, place, count(*) AS n, count(DISTINCT coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')) AS kinds FROM t GROUP BY pair_id, place),
x AS (
  SELECT pair_id, coalesce(min(CASE WHEN n < 2 OR kinds > 1 THEN place END), count(*))::BIGINT AS prefix_turns FROM p GROUP BY pair_id),
r AS (
  SELECT t.pair_id, CASE WHEN place < prefix_turns THEN 'prompt' ELSE side END AS part, side, place, role,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' AS said
  FROM t JOIN x ON t.pair_id = x.pair_id),
s AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 1) OVER (PARTITION BY pair_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start
  FROM r WHERE part <> 'prompt' OR side = 'chosen'),
g AS (
  SELECT pair_id,
         coalesce(string_agg(head || said || chr(10), '' ORDER BY place) FILTER (WHERE part = 'prompt'), '') AS prompt,
         coalesce(string_agg(head || said || chr(10), '' ORDER BY place) FILTER (WHERE part = 'chosen'), '') AS chosen,
         coalesce(string_agg(start || '-' || (start + length(said)), ',' ORDER BY place) FILTER (WHERE part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
         coalesce(string_agg(head || said || chr(10), '' ORDER BY place) FILTER (WHERE part = 'rejected'), '') AS rejected,
         coalesce(string_agg(start || '-' || (start + length(said)), ',' ORDER BY place) FILTER (WHERE part = 'rejected' AND role = 'assistant'), '') AS rejected_mask
  FROM s GROUP BY pair_id)
SELECT g.pair_id, x.prefix_turns, prompt, chosen, chosen_mask, rejected, rejected_mask FROM g JOIN x ON g.pair_id = x.pair_id
"""
