"""Licence scans by a positional index of rare words, with DataFrame functions only.

Templates are licence notices, statements and phrases; a word's weight is its inverse document frequency, counted over
all texts. Each text is cut into words once, and only the places of licence words are kept. A text's highest-IDF licence
words, those down to the least of any template's rarest word, look up the templates that it may hold; their postings
alone are intersected with the text's places: a posting at place t and a word at place d vote for a template that starts
at d - t. A start counts if its template's rarest word is there; the votes of the template's other words at the same start
are its coverage. A template matches where all words of its mandatory key phrase stand, that is, consecutively, and
its coverage is at least LEAST_COVERAGE. The base phrases are templates that are their own key phrase, so every place
where one stands is found.

Defined cases: null and empty texts have no words, no labels and score 0; rows are kept apart by a row number, so
repeated rows and ids get a result each; equal weights are ordered by the word; an empty table gives an empty result;
columns other than doc_id and text are never read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, load, settled

#: Fixed value: the words of a text after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Label, statement, and the key phrase that must stand in it.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution", "creative commons attribution"),
    ("mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software", "distribute this software"),
    ("proprietary", "copyright all rights reserved", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "this program is free software you can redistribute it"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "this library is free software you can redistribute it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: Share of a template's weight that must stand at one start.
LEAST_COVERAGE = 0.5


def templates() -> list[dict]:
    """Every template: id, label, whether it is a base phrase, its words and the places of its key phrase."""
    out = [{"label": label, "base": True, "words": phrase.split(), "key": range(len(phrase.split()))} for phrase, label in BASE.items()]
    for label, statement, key in TEMPLATES:
        words, phrase = statement.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append({"label": label, "base": False, "words": words, "key": range(at, at + len(phrase))})
    return [x | {"template": i} for i, x in enumerate(out)]


def vocabulary() -> list[str]:
    return sorted({w for t in templates() for w in t["words"]})


def located(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, hits) for each row: how many words it has, and the places of licence words."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    kept = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("at"))), lambda s: s["word"].isin(vocabulary()))
    return docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), kept.alias("hits")).withColumn("row", F.monotonically_increasing_id())


def weights(hits: DataFrame) -> dict[str, float]:
    """IDF of every licence word over all rows; as many numbers as the templates have words."""
    found = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda s: s["word"]))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = {r["word"]: r["df"] for r in found.collect()}
    n = hits.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary()}


def postings(idf: dict[str, float]) -> list[tuple]:
    """(word, template, place, weight share, key, rarest) of every template word; rarest is of the key phrase's words."""
    out = []
    for t in templates():
        total = sum(idf[w] for w in t["words"])
        rarest = max(t["key"], key=lambda i: (idf[t["words"][i]], t["words"][i]))
        out += [(w, t["template"], i, idf[w] / total, i in t["key"], i == rarest) for i, w in enumerate(t["words"])]
    return out


def matches(hits: DataFrame, idf: dict[str, float]) -> DataFrame:
    """(row, template, start, coverage) of the verified starts; start is where the key phrase begins."""
    spark = hits.sparkSession
    rows = postings(idf)
    index = F.broadcast(spark.createDataFrame(rows, "word string, template int, place long, share double, key boolean, rarest boolean"))
    # The text's highest-IDF words: down to the least of the templates' rarest words, so no template that it holds is missed.
    anchors: dict[str, list[int]] = {}
    for word, template, _, _, _, rarest in rows:
        if rarest:
            anchors.setdefault(word, []).append(template)
    high = F.array(*[F.lit(w) for w in vocabulary() if idf[w] >= min(idf[x] for x in anchors)])
    of_word = F.create_map(*[x for w, ts in sorted(anchors.items()) for x in (F.lit(w), F.array(*map(F.lit, ts)))])
    rare = F.array_intersect(F.transform("hits", lambda s: s["word"]), high)
    looked_up = F.flatten(F.transform(rare, lambda w: F.coalesce(F.try_element_at(of_word, w), F.array().cast("array<int>"))))
    asked = hits.withColumn("may_hold", looked_up).where(F.size("may_hold") > 0)
    places = asked.select("row", "may_hold", F.explode("hits").alias("hit")).select("row", "may_hold", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
    votes = places.join(index, "word").where(F.array_contains("may_hold", F.col("template"))).drop("may_hold")
    tally = votes.groupBy("row", "template", (F.col("at") - F.col("place")).alias("begin")).agg(F.max("rarest").alias("rarest"), F.sum(F.col("key").cast("int")).alias("keys"), F.sum("share").alias("coverage"))
    facts = F.broadcast(spark.createDataFrame([(t["template"], t["label"], t["base"], len(t["key"]), t["key"][0]) for t in templates()], "template int, label string, base boolean, size int, first long"))
    whole = tally.where("rarest").join(facts, "template").where((F.col("keys") == F.col("size")) & (F.col("base") | (F.col("coverage") >= LEAST_COVERAGE)))
    return whole.select("row", "template", "label", "base", (F.col("begin") + F.col("first")).alias("start"), F.least("coverage", F.lit(1.0)).alias("coverage"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs."""
    hits = settled(located(docs.select("doc_id", "text")), "licence-words")
    found = matches(hits, weights(hits))
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(which)), ",")
    base = F.when(F.col("base"), F.col("start"))
    by_row = found.groupBy("row").agg(F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"), F.max("coverage").alias("score"))
    out = hits.drop("hits").join(by_row, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    ts = templates()
    words = ", ".join(f"('{w}', {t['template']}, {i}, {str(i in t['key']).lower()})" for t in ts for i, w in enumerate(t["words"]))
    facts = ", ".join(f"({t['template']}, '{t['label']}', {str(t['base']).lower()}, {len(t['key'])}, {t['key'][0]})" for t in ts)
    return rf"""
WITH t(word, template, place, key) AS (VALUES {words}),
f(template, label, base, size, first) AS (VALUES {facts}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS (SELECT row, word, pos FROM (SELECT row, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d) WHERE word IN (SELECT word FROM t)),
v AS (SELECT DISTINCT word FROM t),
idf AS (SELECT v.word, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (count(DISTINCT h.row) + 1)) + 0.001::DOUBLE AS idf FROM v LEFT JOIN h ON v.word = h.word GROUP BY v.word),
total AS (SELECT template, sum(idf) AS total FROM t JOIN idf ON t.word = idf.word GROUP BY template),
tally AS (
  SELECT row, t.template, pos - place AS begins, sum(CASE WHEN key THEN 1 ELSE 0 END) AS keys, sum(idf / total) AS coverage
  FROM h JOIN t ON h.word = t.word JOIN idf ON t.word = idf.word JOIN total ON t.template = total.template GROUP BY row, t.template, pos - place),
m AS (
  SELECT row, label, base, begins + first AS starts, least(coverage, 1.0::DOUBLE) AS coverage
  FROM tally JOIN f ON tally.template = f.template WHERE keys = size AND (base OR coverage >= {LEAST_COVERAGE}::DOUBLE)),
g AS (
  SELECT row, count(*) FILTER (WHERE base) AS n_base, min(starts) FILTER (WHERE base) AS first_word, max(starts) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM m GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0::DOUBLE), 9) AS score
FROM d LEFT JOIN g ON d.row = g.row
"""


OP2_SQL = _op2_sql()
assert all(re.fullmatch(r"[a-z0-9]+", w) for w in vocabulary())
