"""Grouping of spelling variants: words that differ by one code point, found by wildcard groups without pairs.

1. counted_words: runs of Latin letters of whole texts, one of 199 distinct runs of a document losing a letter, counted
   within each task first and then by word.
2. Replacements: a word is put into one group for each of its places, keyed by (place, prefix, suffix). A group keeps
   its size and its two most frequent words: a member is near to all others, and its best one is the first, or the
   second if the member is the first itself. A group holds one word for each letter of the alphabet at most.
3. Insertions and deletions: every distinct deletion of a word joins the vocabulary. The longer word gets one row for
   each deletion that is a word; the shorter one gets the number and the best of the words that shrink to it, summed by
   deletion before the join.
4. The three are summed by word. Forms have at least five times the occurrences, so chains of forms have no circles and
   few links; roots are found by jumping over as many links as are known so far.

Keys of words beyond KEY_CHARS code points are hashes (SHA-256), so that a run of thousands of letters needs no
quadratic number of bytes.

Defined cases: null and empty texts have no words; a null doc_id counts as empty text before the colon; rows that repeat
an id or a text count as often as they stand; ties of frequency go to the word that is smaller in code-point order; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, load, settled

#: One of so many runs of a document loses a letter; code points and occurrences of a word at least; how
#: many times the occurrences a form has.
LOSES_ONE_OF, LEAST_CHARS, LEAST_COUNT, FORM_TIMES = 199, 6, 5, 5
#: Words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Longer keys are hashed.
KEY_CHARS = 64
#: Latin-1 has the letters' code points as bytes: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Lower-cased runs of letters, in Latin-1; code points beyond it are no letters."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def worn(run: bytes, seed: int) -> bytes:
    """The run, without one letter where the checksum of id and run says so; seed is the checksum of "<doc_id>:"."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % LOSES_ONE_OF:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches):
    """(word, n) of rows (doc_id as text, text); a word may come more than once."""
    held: dict[bytes, int] = {}

    def passed():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seed = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(runs(text)).items():
                if len(run) >= LEAST_CHARS and len(word := worn(run, seed)) >= LEAST_CHARS:
                    held[word] = held.get(word, 0) + n
        if len(held) >= HELD_WORDS:
            yield passed()
            held.clear()
    yield passed()


def counted_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs, which has doc_id and text: words with at least ``least`` occurrences."""
    by_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _key(text: Column) -> Column:
    return F.when(F.length(text) <= KEY_CHARS, text).otherwise(F.concat(F.lit("#"), F.sha2(text.cast("binary"), 256)))


def _places(words: DataFrame) -> DataFrame:
    """One row for each word and place, with what stands before and after it."""
    at = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word"))))
    word = F.col("word")
    return at.withColumns({"head": word.substr(F.lit(1), F.col("at") - 1), "rest": word.substr(F.col("at") + 1, F.length(word))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words (word, n) that have a near word; best is (-n, word) of the most frequent one."""
    known = words.select(_key(F.col("word")).alias("key"), "word", "n")
    places = _places(words)
    # A group has as many members as letters can stand at its place.
    wild = places.select(_key(F.concat("head", F.lit("*"), "rest")).alias("key"), F.struct((-F.col("n")).alias("low"), "word").alias("own"))
    groups = wild.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("own")).alias("members")).where("size > 1")
    groups = groups.select("size", F.slice("members", 1, 2).alias("top"), F.explode("members").alias("own"))
    best = F.when(F.col("own.word") == F.col("top")[0]["word"], F.col("top")[1]).otherwise(F.col("top")[0])
    replaced = groups.select(F.col("own.word").alias("word"), (F.col("size") - 1).alias("near"), best.alias("best"))

    # Letters that repeat give one deletion: only the first of them is taken.
    first = (F.col("at") == 1) | (F.col("word").substr(F.col("at"), F.lit(1)) != F.col("word").substr(F.col("at") - 1, F.lit(1)))
    shrunk = places.where(first & (F.col("at") <= F.length("word")) & (F.length("word") > 1)).select(_key(F.concat("head", "rest")).alias("key"), F.col("word").alias("long"), F.struct((-F.col("n")).alias("low"), "word").alias("own"))
    longer = shrunk.join(known, "key").select(F.col("long").alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col("n")).alias("low"), "word").alias("best"))
    grown = shrunk.groupBy("key").agg(F.count(F.lit(1)).alias("near"), F.min("own").alias("best"))
    shorter = grown.join(known, "key").select("word", "near", "best")
    return replaced.unionByName(longer).unionByName(shorter).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): links double at each step, and a chain has about log5 of the largest count."""
    up = settled(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = up.select(F.col("word").alias("from"), F.col("root").alias("to"))
        moved = settled(up.join(onward, F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        up = moved.select("word", "root")
        if not moved.where("moved").head(1):
            return up


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs, which has doc_id and text."""
    words = settled(counted_words(docs), "words")
    found = words.join(near_words(words), "word", "left")
    enough = -F.col("best.low") >= FORM_TIMES * F.col("n")
    found = settled(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.low")).alias("form_n")), "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(load(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH crc AS (
  -- The checksum's table of 256 remainders, by its polynomial.
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
found AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295]::UBIGINT[], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END))::UBIGINT[]),
         lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h
  FROM found, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS wild, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.wild = b.wild AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(low := -m, w := other)) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.low >= 5 * w.n THEN b.w END AS form, CASE WHEN -b.low >= 5 * w.n THEN -b.low END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.word),
up AS (
  SELECT * FROM (WITH RECURSIVE chain(word, so_far, depth) AS (
    SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.so_far = f.word WHERE f.form IS NOT NULL)
  SELECT word, arg_max(so_far, depth) AS root FROM chain GROUP BY word))
SELECT f.word, f.form, u.root, f.n::BIGINT AS n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN up u ON f.word = u.word
"""
