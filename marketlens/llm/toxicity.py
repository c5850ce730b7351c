"""Toxicity by a weighted finite-state pattern grammar.

Five transducers (insult, threat, target, negation, reported speech) read the word classes of a clause and are composed
into one machine: states multiply; what insult, threat and target machines emit adds up, what the others say about it
multiplies. A target counts before an insult and after it. A document's evidence is the sum of its matched clauses, not
of isolated words; a clause without an insult or threat matches nothing. Words of the insult class and their weights
are learned from labelled rows (log odds of the documents that have the word) by a statistical threshold alone; other
classes are fixed lists. The evidence becomes a probability by logistic regression over grid cells.

Words and regression are fitted on at most TRAIN_ROWS labelled documents, those of the smallest hashes; they are written
once, so that fitting reads a table of bounded size, and all documents are scored in one pass without any shuffle.

Defined cases: null and empty texts have no clause and get the score of a document without any; null labels and labels
of absent documents are ignored; several labels of one document count as their mean, rounded up; without any training
row, only the fixed lists hold, and the score is that of fixed coefficients; repeated rows are scored each; columns
other than doc_id and text are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, crc_of_id, load, settled

#: Held-out fold of the labels.
FOLDS, HELD_OUT = 5, 0
#: Labelled documents that the classifier is fitted on at most.
TRAIN_ROWS = 100_000
#: Likelihood-ratio statistic that a word must reach to be learned.
LEAST_G2 = 24.0
#: Partial word counts that a task holds before it passes them on.
HELD_WORDS = 200_000
#: Weight of a listed word that training has not seen, and least weight of a word to be of the insult class.
UNSEEN_WEIGHT, LEAST_WEIGHT = 2.0, 1.0
#: Weight of a target that follows an insult or threat.
TARGET_WEIGHT = 1.0
#: Factors: of a second insult in a clause, of a threat, of a target before, of negation and reported speech before; and
#: the words that each of the last three and a target after reach.
SECOND, THREATENS, AIMED, DENIED, QUOTED = 1.2, 1.3, 1.4, 0.3, 0.5
TARGET_REACH, NOT_REACH, SAYS_REACH, AFTER_REACH = 6, 3, 12, 4

# Word lists of the classes, and clause ends.
INSULT = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb fool idiota estúpido imbécil basura idiotisch dumm abschaum versager stupide crétin ordure".split()
THREAT = "kill hurt destroy murder punch strangle töten umbringen schlagen tuer frapper matar golpear".split()
TARGET = "you your yours he she they them him her du dich dein ihr sie tu toi vous il elle ils usted ustedes ellos ellas".split()
NEGATION = "not no never neither nor without nicht kein keine nie ne pas jamais sin nunca jamás tampoco".split()
REPORTED = "said says called wrote quoted claimed reported allegedly sagte nannte schrieb dit appelé écrit dijo llamó escribió".split()
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+")
CLAUSE_END = frozenset(".!?;\n")
OTHER, BAD, DANGER, WHOM, NOT, SAYS = range(6)


class Machine:
    """Deterministic transducer: step[state][symbol] = (next state, what it emits, factor of what all emit)."""

    def __init__(self, step: list[list[tuple[int, float, float]]]):
        self.step = step

    def __matmul__(self, other: Machine) -> Machine:
        """Composition on a shared input: product states, emissions added, factors multiplied."""
        wide = len(other.step)
        step = []
        for p, q in product(range(len(self.step)), range(wide)):
            pairs = zip(self.step[p], other.step[q], strict=True)
            step.append([(a * wide + b, d + e, f * g) for (a, d, f), (b, e, g) in pairs])
        return Machine(step)

    def outputs(self) -> list[list[tuple[int, float]]]:
        """step as (next state, output of a word of weight 1)."""
        return [[(a, e * f) for a, e, f in row] for row in self.step]


def insults(symbol: int, factor: float) -> Machine:
    """A word of the class emits, a second one of a clause more than the first; other words emit nothing."""
    step = [[(0, 0.0, 1.0)] * 6, [(1, 0.0, 1.0)] * 6]
    step[0][symbol], step[1][symbol] = (1, factor, 1.0), (1, factor * SECOND, 1.0)
    return Machine(step)


def within(symbol: int, reach: int, factor: float) -> Machine:
    """After symbol, what the next reach words emit is multiplied by factor."""
    step = []
    for state in range(reach + 1):
        row = [(max(0, state - 1), 0.0, factor if state else 1.0)] * 6
        row[symbol] = (reach, 0.0, factor if state else 1.0)
        step.append(row)
    return Machine(step)


def targets() -> Machine:
    """Targets raise what is emitted within TARGET_REACH words, and emit themselves within AFTER_REACH words of an insult or threat."""
    before = within(WHOM, TARGET_REACH, AIMED)
    after = []
    for state in range(AFTER_REACH + 1):
        row = [(max(0, state - 1), 0.0, 1.0)] * 6
        row[BAD] = row[DANGER] = (AFTER_REACH, 0.0, 1.0)
        row[WHOM] = (max(0, state - 1), float(state > 0), 1.0)
        after.append(row)
    for row in before.step:  # a target's own output is not raised by a target before it
        row[WHOM] = (row[WHOM][0], 0.0, 1.0)
    return before @ Machine(after)


def grammar() -> list[list[tuple[int, float]]]:
    """The five machines as one."""
    return (insults(BAD, 1.0) @ insults(DANGER, THREATENS) @ targets() @ within(NOT, NOT_REACH, DENIED) @ within(SAYS, SAYS_REACH, QUOTED)).outputs()


def classes_of(weights: dict[str, float]) -> dict[str, tuple[int, float]]:
    """word -> (class, weight) of the whole lexicon; learned weights hold over the lists' default."""
    out = {}
    for words, kind, weight in ((TARGET, WHOM, TARGET_WEIGHT), (NEGATION, NOT, 0.0), (REPORTED, SAYS, 0.0)):
        out |= dict.fromkeys(words, (kind, weight))
    out |= {w: (BAD, v) for w, v in weights.items() if v >= LEAST_WEIGHT and w not in out}
    for words, kind in ((INSULT, BAD), (THREAT, DANGER)):
        for w in words:
            if (v := weights.get(w, UNSEEN_WEIGHT)) >= LEAST_WEIGHT:
                out[w] = (kind, v)
    return out


def clauses(tokens: list[str], lexicon: dict, step: list) -> list[float]:
    """Weights of the matched clauses of a lower-cased token list."""
    found, total, state = [], 0.0, 0
    get = lexicon.get
    for token in tokens:
        hit = get(token)
        if hit is None:
            if token[0] in CLAUSE_END:
                if total:
                    found.append(total)
                total, state = 0.0, 0
            else:
                state = step[state][OTHER][0]
        else:
            kind, weight = hit
            state, factor = step[state][kind]
            total += weight * factor
    return found + [total] if total else found


def _word_counts(batches):
    """(word, toxic, clean): of labelled texts, documents of either label that have the word, summed within a task."""
    toxic, clean, rows = Counter(), Counter(), [0, 0]

    def out():
        words = list(toxic.keys() | clean.keys()) + [""]
        toxic[""], clean[""] = rows[1], rows[0]
        batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["word", "toxic", "clean"])
        toxic.clear(), clean.clear()
        rows[:] = 0, 0
        return batch

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update({w for w in TOKEN.findall((text or "").lower()) if w[0] not in CLAUSE_END})
            rows[label] += 1
            if len(toxic) + len(clean) > HELD_WORDS:
                yield out()
    yield out()


def learn_words(labelled: DataFrame) -> dict[str, float]:
    """Learned weights by word from (text, toxic), a table of at most TRAIN_ROWS rows."""
    counts = labelled.select("text", "toxic").mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = settled(counts.where("toxic > 0"), "toxic-words")
    total = counts.where("word = ''").first()
    if not total or not total["clean"]:
        return {}
    n1, n0 = total["toxic"], total["clean"]
    a, b = F.col("toxic"), F.col("clean")
    share = (a + b) / F.lit(n1 + n0)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (share * n))).otherwise(0.0)
    weight = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    known = counts.where("word <> ''").select("word", weight.alias("weight"), (2 * (part(a, n1) + part(b, n0))).alias("g2"))
    listed = known.where(F.col("word").isin(INSULT + THREAT)).select("word", "weight").collect()
    found = known.where((F.col("g2") >= LEAST_G2) & (F.col("weight") >= LEAST_WEIGHT)).select("word", "weight").collect()
    return {r["word"]: r["weight"] for r in [*listed, *found]}


def scanner(weights: dict[str, float]):
    """The function texts -> (words, matched clauses, greatest clause, sum of clauses), each a list."""
    lexicon, step = classes_of(weights), grammar()
    bad = frozenset(w for w, (kind, _) in lexicon.items() if kind in (BAD, DANGER))

    def scan(texts: list[str | None]):
        rows = []
        for text in texts:
            tokens = TOKEN.findall((text or "").lower())
            found = [] if bad.isdisjoint(tokens) else clauses(tokens, lexicon, step)
            rows.append((len(tokens), len(found), max(found, default=0.0), sum(found)))
        return list(zip(*rows, strict=True)) if rows else [()] * 4

    return scan


def features(total, words) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and evidence per hundred words, on a grid."""
    total, words = np.asarray(total, float), np.asarray(words, float)
    return tuple(np.floor(np.minimum(np.log1p(x), 6.0) * 8) / 8 for x in (total, 100 * total / np.maximum(words, 1)))


def fitted(cells: list[tuple[float, float, int, int]]) -> np.ndarray:
    """Coefficients (constant, evidence, density) from cells (x1, x2, clean, toxic) by ridge-penalised Newton steps."""
    w = np.array([-3.0, 2.0, 1.0])
    if not cells:
        return w
    data = np.array(cells, float)
    x = np.column_stack([np.ones(len(data)), data[:, 0], data[:, 1]])
    n, y = data[:, 2] + data[:, 3], data[:, 3]
    prior = np.diag([0.01, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - n * p) - prior @ w
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior, grad).clip(-2, 2)
    return w


class Model:
    """Learned weights of words and coefficients of the regression."""

    def __init__(self, weights: dict[str, float], coefficients: np.ndarray):
        self.weights, self.coefficients = weights, coefficients

    def scores(self):
        """The function texts -> (score, matched clauses, evidence)."""
        scan, w = scanner(self.weights), self.coefficients

        def score(texts):
            words, matched, _, total = scan(texts)
            x1, x2 = features(total, words)
            return 1 / (1 + np.exp(-(w[0] + w[1] * x1 + w[2] * x2))), np.array(matched, np.int64), np.array(total, np.float64)

        return score


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows outside the held-out fold: the most of smallest hash, by document."""
    held = crc_of_id(F.col("doc_id"), FOLDS) == HELD_OUT
    known = labels.where("toxic is not null and doc_id is not null").where(~held).groupBy("doc_id").agg(F.when(F.avg("toxic") >= 0.5, 1).otherwise(0).alias("toxic"))
    known = settled(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "known")
    # At most `most` ids of bounded size are broadcast; each has one text, of those under an id the one of smallest hash.
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("x"))
    labelled = settled(one.select("x.text", "x.toxic"), "labelled")
    weights = learn_words(labelled)
    scan = scanner(weights)

    def cells(batches):
        for batch in batches:
            words, _, _, total = scan(batch.column(0).to_pylist())
            x1, x2 = features(total, words)
            yield pa.RecordBatch.from_arrays([pa.array(x1), pa.array(x2), batch.column(1).cast(pa.int64())], ["x1", "x2", "toxic"])

    found = labelled.mapInArrow(cells, "x1 double, x2 double, toxic long").groupBy("x1", "x2").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    return Model(weights, fitted([tuple(r) for r in found.collect()]))  # at most 49 x 49 cells


def scored_by(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, score, matched, evidence) for every row of docs, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        score = shared.value.scores()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, score(batch.column(1).to_pylist()))], ["doc_id", "score", "matched", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double, matched long, evidence double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, matched, evidence) for every row of docs; labels has (doc_id, toxic)."""
    by_batches(docs.sparkSession)
    held = crc_of_id(F.col("doc_id"), FOLDS) == HELD_OUT
    found = scored_by(train(docs, labels), docs)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matched", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; each row is judged by its own text, whatever its id."""
    by_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = shared.value.scores()
        for texts in parts:
            yield pd.Series(judge(texts.tolist())[0])

    return docs.where(score("text") < 0.5)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
