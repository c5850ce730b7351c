"""Language identification by interpolated Kneser-Ney character models.

One pass counts the 4-grams of characters of all training texts by language (letters lower-cased, all else one space;
partial counts within tasks, then one sum by key). Each language's model discounts its counts and interpolates down to
single characters with continuation counts. All probabilities stand in arrays sorted by the grams' 64-bit keys; grams
that no language has seen are looked up order by order. The language with the least cross-entropy per character wins.
Rejection is calibrated on the training texts: by language and length class, a text is rejected if its cross-entropy is
SPREADS standard deviations above the mean there.

Defined cases: a null text, and one without letters, is `und`, score 0 and rejected; without training rows everything
is `und`; empty text has no letters; rows with a null lang are scored but not learned; repeated rows count each; ties
go to the smaller language name; only doc_id, text and (for training) lang are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, crc_of_id, load, settled

#: Held-out fold.
FOLDS, HELD_OUT = 4, 2
#: Order of the models, the discount, and the size of the alphabet for what was never seen.
ORDER, DISCOUNT, ALPHABET = 4, 0.75, 4096
#: Size of a language's model: its most frequent 4-grams (counted over all rows).
MODEL_GRAMS = 400_000
#: Characters that are worked on at once, and grams that a task holds before it passes partial counts on.
CHUNK, HELD_GRAMS = 1_000_000, 1_000_000
#: Standard deviations above the mean that reject, and the least deviation.
SPREADS, LEAST_SPREAD = 8.0, 0.05
#: Characters whose cross-entropy makes a text's score; more do not make it surer.
SURE_CHARS = 50

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def chunks(texts: list[str | None], limit: int = CHUNK):
    """(first, end) of runs of texts of about limit characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the 4-grams that end at each letter and word end, and the number of them in each text.

    A key packs four folded 16-bit characters; 0 is the space, and stands for what is before a text too.
    """
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered])
    raw = np.frombuffer(("\n" + "\n".join(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    code = np.where(_is_letter()[raw], np.maximum(raw & 0xFFFF, 1), 0).astype(np.uint64)
    first = np.r_[True, owner[1:] != owner[:-1]]
    keep = first | (code > 0) | np.r_[True, code[:-1] > 0]
    code, owner, first = code[keep], owner[keep], first[keep]
    start = np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))
    key = code.copy()
    for back in (1, 2, 3):
        prior = np.zeros_like(code)
        prior[back:] = code[:-back]
        prior[np.arange(len(code)) - back < start] = 0
        key |= prior << np.uint64(16 * back)
    inside = ~first
    return key[inside], np.bincount(owner[inside], minlength=len(texts))


def _counted(batches):
    """(lang, gram, n): partial counts of 4-grams by language."""
    held: dict[str, list] = {}

    def merged(lang):
        keys = np.concatenate([k for k, _ in held[lang]])
        counts = np.concatenate([c for _, c in held[lang]])
        distinct, where = np.unique(keys, return_inverse=True)
        held[lang] = [(distinct, np.bincount(where, counts, len(distinct)).astype(np.int64))]
        return len(distinct)

    def out(lang):
        merged(lang)
        keys, counts = held.pop(lang)[0]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in chunks(texts):
            for lang in set(langs[a:b]):
                keys, _ = grams([t for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == lang])
                held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                if len(held[lang]) >= 8 and merged(lang) > HELD_GRAMS:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of their values, and how many there are of each."""
    distinct, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, np.bincount(where, values, len(distinct)), n


class KneserNey:
    """One language: for each order, discounted probabilities by gram and left-over weights by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER, 0, -1):
            context, total, kinds = _grouped(keys >> np.uint64(16), counts)
            whole = total[np.searchsorted(context, keys >> np.uint64(16))]
            rank = np.argsort(keys)
            self.levels.append(((keys[rank], (np.maximum(counts - DISCOUNT, 0) / whole)[rank]), (context, DISCOUNT * kinds / total)))
            # Continuation counts: of how many characters the shorter gram is seen to follow.
            keys, counts, _ = _grouped(keys & np.uint64((1 << (16 * (order - 1))) - 1), np.ones(len(keys)))

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1.0 / ALPHABET)
        for order, (grams_, contexts) in enumerate(reversed(self.levels), 1):
            own = keys & np.uint64((1 << (16 * order)) - 1)
            p = _found(grams_, own, 0.0) + _found(contexts, own >> np.uint64(16), 1.0) * p
        return p


class Model:
    """All languages: log2 probabilities of every seen gram, and the languages' own tables for the rest."""

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(tables)
        self.models = [KneserNey(*tables[x]) for x in self.langs]
        self.keys = np.unique(np.concatenate([k for k, _ in tables.values()])) if tables else np.empty(0, np.uint64)
        self.bits = self.bits_of(self.keys)

    def bits_of(self, keys: np.ndarray) -> np.ndarray:
        return np.column_stack([-np.log2(m.probability(keys)) for m in self.models]).astype(np.float32) if self.models else np.empty((len(keys), 0), np.float32)

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character by text and language, and the characters that count."""
        keys, n = grams(texts)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        bits = self.bits[at]
        rest = np.flatnonzero(self.keys[at] != keys)
        if len(rest):
            new, where = np.unique(keys[rest], return_inverse=True)
            bits[rest] = self.bits_of(new)[where]
        some = np.flatnonzero(n)
        sums = np.zeros((len(texts), len(self.langs)))
        if len(some):
            sums[some] = np.add.reduceat(bits, np.r_[0, np.cumsum(n[some])[:-1]], axis=0, dtype=np.float64)
        return sums / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame) -> Model:
    """The model from (text, lang); what comes to the driver is bounded by MODEL_GRAMS a language."""
    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_counted, "lang string, gram long, n long")
    counts = settled(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    tables = {}
    for lang in sorted(r["lang"] for r in counts.select("lang").distinct().collect()):
        own = counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(MODEL_GRAMS).select("gram", "n").toArrow()
        keys = own.column("gram").to_numpy().astype(np.int64).view(np.uint64)
        rank = np.argsort(keys)
        tables[lang] = keys[rank], own.column("n").to_numpy().astype(np.float64)[rank]
    return Model(tables)


def judged(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, bits per character and characters of each text."""
    parts = []
    for a, b in chunks(texts) if model.langs else ():
        ce, n = model.cross_entropy(texts[a:b])
        best = ce.argmin(axis=1)
        gap = (ce - ce.min(axis=1, keepdims=True)) * np.minimum(n, SURE_CHARS)[:, None]
        score = np.where(n > 0, 1 / np.exp2(-gap).sum(axis=1), 0.0)
        parts.append((np.where(n > 0, np.array(model.langs, object)[best], "und"), score, ce.min(axis=1), n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.full(len(texts), "und", object), *[np.zeros(len(texts))] * 3)


def scored_by(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, learned, lang_pred, score, bits, chars): each row of docs by the model; learned is its own lang."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            lang, score, bits, n = judged(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(n.astype(np.int64))], ["doc_id", "learned", "lang_pred", "score", "bits", "chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    learned = F.when(F.col("text").isNotNull(), F.col("lang").cast("string")).alias("learned")
    schema = f"doc_id {kind}, learned string, lang_pred string, score double, bits double, chars long"
    return docs.select("doc_id", "text", learned).mapInArrow(scored, schema)


def length_class() -> Column:
    return F.least(F.floor(F.log2(F.greatest("chars", F.lit(1)))), F.lit(12)).alias("length")


def calibration(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean and spread of the cross-entropy of training texts by language and length class, and by language: bounded tables."""
    right = found.where("learned = lang_pred and chars > 0").select("lang_pred", "bits", length_class())
    sums = right.groupBy("lang_pred", "length").agg(F.count(F.lit(1)).alias("n"), F.sum("bits").alias("s"), F.sum(F.col("bits") * F.col("bits")).alias("q"))
    sums = settled(sums, "calibration")

    def spread(n, s, q):
        return F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))

    near = sums.where("n >= 30").select(F.col("lang_pred").alias("l1"), F.col("length").alias("k1"), (F.col("s") / F.col("n")).alias("mean"), spread(F.col("n"), F.col("s"), F.col("q")).alias("spread"))
    whole = sums.groupBy(F.col("lang_pred").alias("l2")).agg(*[F.sum(x).alias(x) for x in ("n", "s", "q")])
    wide = whole.select("l2", (F.col("s") / F.col("n")).alias("mean2"), spread(F.col("n"), F.col("s"), F.col("q")).alias("spread2"))
    return near, wide


def identify(docs: DataFrame, fold=None) -> DataFrame:
    """(doc_id, lang_pred, score, bits, chars, rejected) for every row of docs, learned from its rows where fold holds."""
    by_batches(docs.sparkSession)
    fold = F.lit(True) if fold is None else fold
    model = train(docs.where(fold))
    found = settled(scored_by(model, docs.withColumn("lang", F.when(fold, F.col("lang")))), "languages")
    near, wide = calibration(found)
    out = found.withColumn("length", length_class())
    out = out.join(F.broadcast(near), (F.col("lang_pred") == F.col("l1")) & (F.col("length") == F.col("k1")), "left").join(F.broadcast(wide), F.col("lang_pred") == F.col("l2"), "left")
    most = F.coalesce("mean", "mean2") + SPREADS * F.greatest(F.coalesce("spread", "spread2"), F.lit(LEAST_SPREAD))
    rejected = (F.col("chars") == 0) | F.coalesce(F.col("bits") > most, F.lit(False))
    # What lies beyond the limit lowers the score of a rejected text.
    beyond = F.least(F.col("chars"), F.lit(SURE_CHARS)) * F.greatest(F.col("bits") - most, F.lit(0.0))
    score = F.col("score") * F.coalesce(F.pow(F.lit(0.5), beyond), F.lit(1.0))
    return out.select("doc_id", "lang_pred", score.alias("score"), "bits", "chars", rejected.alias("rejected"))


def in_fold():
    return crc_of_id(F.col("doc_id"), FOLDS) != HELD_OUT


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected; each row is judged by its own text, whatever its id."""
    by_batches(docs.sparkSession)
    model = train(docs.where(in_fold()))
    found = scored_by(model, docs.where(in_fold()))
    near, wide = calibration(found)
    # Bounded tables: one row for each language, and for each language and length class.
    limits = {(r["l1"], r["k1"]): r["mean"] + SPREADS * max(r["spread"], LEAST_SPREAD) for r in near.collect()}
    limits |= {(r["l2"], None): r["mean2"] + SPREADS * max(r["spread2"], LEAST_SPREAD) for r in wide.collect()}
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))

    @F.pandas_udf("boolean")
    def known(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, limits = shared.value
        for texts in parts:
            lang, _, bits, n = judged(model, [None if x is None else x for x in texts.tolist()])
            length = np.minimum(np.floor(np.log2(np.maximum(n, 1))), 12)
            most = np.array([limits.get((x, int(k)), limits.get((x, None), np.inf)) for x, k in zip(lang, length, strict=True)])
            yield pd.Series((n > 0) & (bits <= most))

    return docs.where(known("text"))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    found = identify(load(spark, sf_dir, "documents"), in_fold())
    return found.select("doc_id", (~in_fold()).alias("held_out"), "lang_pred", "score", "rejected")
