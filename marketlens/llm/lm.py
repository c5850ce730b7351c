"""Scoring texts by online logistic context mixing of bit predictors, with a word model as the base.

Every byte is coded as eight binary decisions. Five predictors hash their context (the last 2, 3, 4 or 6 bytes, or the
word so far) into tables of bit counts; the log odds of the counts are their inputs to a mixer, whose weights a gate
picks by how often the longest contexts were seen. A refinement stage corrects the mixture by its own confidence.

1. Learning. Each task codes its texts in order: it predicts a portion with what it has counted so far, takes online
   Newton steps on the weights of the gates, and only then counts the portion, so weights are never fitted on counts that
   hold the answer. Portions begin at a few KB and double, so weights are learned whatever a task's share of the corpus. Tasks' counts are summed by block of slots, their weights are averaged by their curvature. Tables
   grow with the training text up to MOST_BITS a predictor; counts of whole words grow without a bound.
2. Scoring. Every document starts from the learned weights and refines them along its text: after each block of
   BLOCK bytes the document's own weights and refinement take a step on what was just coded.
3. Words. A token's probability is a mixture of its bytes' and of its share of all training words: frequent words
   stand in each task, all others are joined by key.

The base sums log10((c + 1) / (N + V + 1)) over words and the end mark.

Defined cases: null text is empty; an empty text is the end mark alone; without training rows all counts are 0; repeated
rows count and score each; a text's result does not depend on the other texts of its task; texts of any length are
coded whole; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import gc
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, crc_of_id, load, mixed64, settled

#: Held-out fold.
FOLDS, HELD_OUT = 7, 2
#: Bytes that each predictor sees; the last one (0) sees the word so far.
ORDERS = (2, 3, 4, 6, 0)
INPUTS = len(ORDERS)
#: Bits of a predictor's number of slots: at least, at most, and training bytes for a slot; short contexts need fewer.
LEAST_BITS, MOST_BITS, BYTES_A_SLOT = 18, 22, 8
SHORT_BITS = {1: 18, 2: 20}
#: Added to both counts of a slot, and the greatest log odds.
PRIOR, MOST_ODDS = 0.3, 8.0
#: Levels of confidence of the two longest contexts (by number of times seen), which make the gates.
LEVELS = np.array([0] + [1] * 2 + [2] * 3 + [3] * 250, np.uint8)
GATES = 16
#: First weights; pull towards the weights before, at the first step of a task, and within a document.
FIRST, PULL, OWN_PULL = 0.3, 20.0, 150.0
#: Steps of the refinement, and the pull of each.
BUCKETS, REFINE_PULL = 17, 60.0
#: Bytes of a document to the first refinement of its weights (blocks then double), the longest block, and bytes worked
#: on at once, in rows of at most STEP_ROWS besides a block.
BLOCK, MOST_BLOCK, CHUNK, STEP_ROWS = 256, 4096, 3_000_000, 8192
#: Bytes that a learning task counts before it predicts anything; portions then double up to CHUNK.
FIRST_PORTION = 4096
#: Slots of a block of counts that is summed as one, and text that one learning task should take.
SLOTS, TASK_BYTES = 4096, 32 << 20
#: Share of the word model in a token's probability.
WORD_SHARE = 0.1
#: Words whose counts stand in each task (the rest is joined), and words that a task holds before it passes counts on.
BROADCAST_WORDS, HELD = 400_000, 400_000
#: Separators of words.
SEPARATORS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: An odd factor and its inverse modulo 2**64, for the hash of a word's start.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: By byte: its decisions' nodes within the two runs of slots, and its decisions as 1 or -1.
_BYTES, _DEPTH = np.arange(256), np.arange(8)[:, None]
NODES = (1 << _DEPTH % 4) | (np.where(_DEPTH < 4, _BYTES >> 4, _BYTES & 15) >> (4 - _DEPTH % 4))
SIGNS = (((_BYTES >> (7 - _DEPTH)) & 1) * 2 - 1).astype(np.float32)


def lowered(texts: list) -> list[bytes]:
    return [(t or b"").lower() for t in texts]


def runs(texts: list[bytes]):
    """(first, end) of runs of texts of about CHUNK bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def portions(texts):
    """Texts in order, in lists of FIRST_PORTION bytes, twice as many, and so on up to CHUNK."""
    held, waiting, most = [], 0, FIRST_PORTION
    for text in texts:
        held.append(text)
        waiting += len(text) + 1
        if waiting >= most:
            yield held
            held, waiting, most = [], 0, min(2 * most, CHUNK)
    if held:
        yield held


class Strings:
    """What each byte of some texts follows: the byte or end mark (0), the bytes before it, and the hash of its word so far."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.code = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        wide = self.code.astype(np.uint64)
        before = np.zeros(len(wide), np.uint64)
        for back in range(1, max(ORDERS) + 1):
            before[back:] |= wide[:-back] << np.uint64(8 * (back - 1))
        for j in range(max(ORDERS)):  # nothing before the start of a text
            at = self.starts + j
            at = at[at < self.starts + self.sizes]
            before[at] &= np.uint64((1 << 8 * j) - 1)
        self.before = before
        with np.errstate(over="ignore"):
            place = np.arange(len(wide))
            power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(wide) - 1), x, np.uint64)]) for x in (FACTOR, INVERSE))
            total = np.r_[np.uint64(0), np.cumsum((wide + np.uint64(1)) * power)[:-1]]  # of all bytes before each place
            first = np.r_[True, SEPARATORS[self.code[:-1]]]
            first[self.starts] = True
            start = np.maximum.accumulate(np.where(first, place, 0))
            self.word = (total - total[start]) * inverse[start]
            self.word[first] = 0

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each distinct string, the number of its places, and the string of every place."""
        with np.errstate(over="ignore"):
            key = mixed64((self.before << np.uint64(8) | self.code) + self.word * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        ranked = key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return order[at], np.diff(np.r_[at, len(key)]), which


def table_bits(train_bytes: int) -> list[int]:
    """Bits of each predictor's number of slots for so much training text."""
    wide = int(np.clip(np.ceil(np.log2(max(1, train_bytes / BYTES_A_SLOT))), LEAST_BITS, MOST_BITS))
    return [min(wide, SHORT_BITS.get(order, wide)) for order in ORDERS]


def slots_of(bits: list[int], code: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The slots of each string's 8 decisions by predictor (INPUTS, 8, n).

    A context's decisions stand in two runs of 16 slots, one for each half of the byte, found by a hash each.
    """
    nodes = [own[code] for own in NODES]
    out = np.empty((INPUTS, 8, len(code)), np.int64)
    high = (code >> 4).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1 << 32)
    base = 0
    with np.errstate(over="ignore"):
        for p, order in enumerate(ORDERS):
            context = (before & np.uint64((1 << 8 * order) - 1) if order else word) * np.uint64(FACTOR) + np.uint64(p)
            for half, known in enumerate((context, context + high)):
                run = (mixed64(known) >> np.uint64(64 - bits[p] + 4)).astype(np.int64) * 16 + base
                for j in range(4 * half, 4 * half + 4):
                    np.add(run, nodes[j], out=out[p, j])
            base += 1 << bits[p]
    return out


def odds_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))).clip(-MOST_ODDS, MOST_ODDS)


def seen_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log2(zeros + ones + 1).astype(np.uint8)


def gates_of(seen: np.ndarray) -> np.ndarray:
    """Gate of each string, from how often its two longest contexts (the last two inputs) were seen, as a logarithm."""
    return LEVELS[seen[-2]] * 4 + LEVELS[seen[-1]]


def buckets_of(x: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(x, -8, 8) + 8).astype(np.int64)


class Learner:
    """Counts, weights and refinement of one task, learned online."""

    def __init__(self, bits: list[int]):
        self.bits = bits
        self.counts = np.zeros(2 * sum(1 << b for b in bits), np.float32)  # zeros and ones by turns
        self.weights = np.full((GATES, INPUTS), FIRST)
        self.curvature = np.zeros((GATES, INPUTS, INPUTS))
        self.refined = np.zeros((2, BUCKETS))  # sums of errors and of their variance
        self.ends = np.zeros(256)

    def learn(self, texts: list[bytes]) -> None:
        """Predict the strings of some texts with what was counted before them, a few at a time, then count them."""
        strings = Strings(texts)
        at, times, _ = strings.distinct()
        later = []
        for i in range(0, len(at), STEP_ROWS):
            part, n = at[i : i + STEP_ROWS], times[i : i + STEP_ROWS].astype(np.float32)
            code = strings.code[part]
            slots, one = slots_of(self.bits, code, strings.before[part], strings.word[part]), SIGNS[:, code] > 0
            self._step(self.counts[2 * slots], self.counts[2 * slots + 1], one, n)
            later.append(((2 * slots + one).astype(np.int32).reshape(INPUTS * 8, -1), n))
        for slots, n in later:
            for own in slots:
                np.add.at(self.counts, own, n)
        # What follows words: the separator or, as 0, the end of the text.
        inside = np.r_[False, ~SEPARATORS[strings.code[:-1]]]
        inside[strings.starts] = False
        last = np.zeros(len(strings.code), bool)
        last[strings.starts + strings.sizes - 1] = True
        self.ends += np.bincount(strings.code[inside & (SEPARATORS[strings.code] | last)], minlength=256)

    def _step(self, zeros, ones, one, times) -> None:
        """One online Newton step for each gate, with the counts of what came before."""
        odds = odds_of(zeros, ones)
        gate = gates_of(seen_of(zeros[:, 0], ones[:, 0]))
        weights = self.weights.astype(np.float32).T[:, gate]
        x = sum(odds[p] * weights[p] for p in range(INPUTS))
        p = 1 / (1 + np.exp(-x.clip(-30, 30)))
        error, bent = (one - p) * times, p * (1 - p) * times
        b = buckets_of(x).ravel()
        self.refined += np.stack([np.bincount(b, v.ravel(), BUCKETS) for v in (error, bent)])
        for g in np.unique(gate):
            own = gate == g
            rows = odds[:, :, own].reshape(INPUTS, -1)
            self.curvature[g] += (rows * bent[:, own].ravel()) @ rows.T
            self.weights[g] += np.linalg.solve(self.curvature[g] + PULL * np.eye(INPUTS), rows @ error[:, own].ravel()).clip(-0.2, 0.2)

    def out(self):
        """(block, numbers) rows that add up: counts by block of slots, and as block -1 the weights by their curvature."""
        for first in range(0, len(self.counts) // 2, SLOTS):
            part = self.counts[2 * first : 2 * (first + SLOTS)]
            if part.any():
                yield first // SLOTS, part.astype(np.float64)
        pulled = np.einsum("gij,gj->gi", self.curvature, self.weights)
        yield -1, np.concatenate([self.curvature.ravel(), pulled.ravel(), self.refined.ravel(), self.ends])


def step_of(place: np.ndarray) -> np.ndarray:
    """The block of each place of a text: BLOCK bytes, then blocks that double up to MOST_BLOCK."""
    doubling = int(np.log2(MOST_BLOCK // BLOCK)) + 1
    early = np.ceil(np.log2(place // BLOCK + 1)).astype(np.int64)
    return np.where(place < MOST_BLOCK, early, place // MOST_BLOCK + doubling - 1)


def pieces(order: np.ndarray, step: np.ndarray, owner: np.ndarray):
    """Places, ordered by step and text, in runs of one step that hold whole blocks of texts."""
    at_step, at_text = step[order], owner[order]
    new_step = np.flatnonzero(np.r_[True, at_step[1:] != at_step[:-1]])
    new_text = np.flatnonzero(np.r_[True, (at_text[1:] != at_text[:-1]) | (at_step[1:] != at_step[:-1])])
    ends = set(new_step.tolist())
    first = 0
    for at in new_text[1:].tolist():
        if at in ends or at - first >= STEP_ROWS:
            yield order[first:at]
            first = at
    if len(order):
        yield order[first:]


class Mixer:
    """The learned model: log odds and confidence by slot, weights, refinement, and what follows words."""

    def __init__(self, bits: list[int]):
        self.bits = bits
        self.odds = np.zeros(sum(1 << b for b in bits), np.float16)
        self.seen = np.zeros(len(self.odds), np.uint8)
        self.weights = np.full((GATES, INPUTS), FIRST)
        self.refined = np.zeros(BUCKETS)
        self.ends = np.full(256, 1 / 256)

    def settle(self, numbers: np.ndarray) -> None:
        """Weights, refinement and ends from the sum of the tasks' last rows."""
        cuts = np.cumsum([GATES * INPUTS**2, GATES * INPUTS, 2 * BUCKETS])
        curvature, pulled, refined, ends = np.split(numbers, cuts)
        square = curvature.reshape(GATES, INPUTS, INPUTS) + PULL * np.eye(INPUTS)
        self.weights = np.linalg.solve(square, (pulled.reshape(GATES, INPUTS) + PULL * FIRST)[:, :, None])[:, :, 0]
        error, bent = refined.reshape(2, BUCKETS)
        self.refined = (error / (bent + REFINE_PULL)).clip(-1, 1)
        self.ends = (ends + 1) / (ends.sum() + 256)

    def bits_of(self, texts: list[bytes]) -> tuple[np.ndarray, Strings]:
        """Bits of each byte and end mark of the texts, each text coded from the learned weights on, block by block."""
        strings = Strings(texts)
        at, _, which = strings.distinct()
        odds = np.empty((len(at), INPUTS * 8), np.float16)
        gate = np.empty(len(at), np.int64)
        for i in range(0, len(at), STEP_ROWS):
            part = at[i : i + STEP_ROWS]
            slots = slots_of(self.bits, strings.code[part], strings.before[part], strings.word[part])
            odds[i : i + STEP_ROWS] = self.odds[slots].reshape(INPUTS * 8, -1).T
            gate[i : i + STEP_ROWS] = gates_of(self.seen[slots[:, 0]])
        n = len(texts)
        weights = np.broadcast_to(self.weights.astype(np.float32), (n, GATES, INPUTS)).copy()
        curved = np.zeros((n, GATES, INPUTS), np.float32)
        refined = np.broadcast_to(self.refined.astype(np.float32), (n, BUCKETS)).copy()
        swayed = np.zeros((n, BUCKETS), np.float32)
        owner = np.repeat(np.arange(n), strings.sizes)
        step = step_of(np.arange(len(owner)) - strings.starts[owner])
        order = np.argsort(step.astype(np.int16) if step.max(initial=0) < 32_000 else step, kind="stable")
        cost = np.empty(len(owner), np.float32)
        for places in pieces(order, step, owner):
            string, text = which[places], owner[places]
            low, texts_here = text[0], text[-1] - text[0] + 1
            text = text - low
            own = odds[string].T.astype(np.float32, order="C").reshape(INPUTS, 8, -1)
            s, cell = SIGNS[:, strings.code[places]], text * GATES + gate[string]
            w, h = (v[low : low + texts_here].reshape(-1, INPUTS) for v in (weights, curved))
            here = np.ascontiguousarray(w[cell].T)
            x = own[0] * here[0]
            for p in range(1, INPUTS):
                x += own[p] * here[p]
            bucket = (buckets_of(x) + text * BUCKETS).ravel()
            r, t = (v[low : low + texts_here].reshape(-1) for v in (refined, swayed))
            e = np.exp(-(s * (x + r[bucket].reshape(x.shape))).clip(-20, 20))
            cost[places] = np.log(1 + e).sum(axis=0)
            wrong = e / (1 + e)
            error, bent = s * wrong, wrong * (1 - wrong)
            for p in range(INPUTS):
                h[:, p] += np.bincount(cell, (own[p] * own[p] * bent).sum(axis=0), len(w))
                w[:, p] += np.bincount(cell, (own[p] * error).sum(axis=0), len(w)) / (OWN_PULL + INPUTS * h[:, p])
            t += np.bincount(bucket, bent.ravel(), len(t))
            r += np.bincount(bucket, error.ravel(), len(t)) / (REFINE_PULL + 2 * t)
        return cost.astype(np.float64) / np.log(2), strings

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text outside its words, and for all words in order: the text, the bits with what follows, and the share of that."""
        cost, strings = self.bits_of(texts)
        code = strings.code
        last = np.zeros(len(code), bool)
        last[strings.starts + strings.sizes - 1] = True
        inside = ~SEPARATORS[code] & ~last
        before = np.r_[False, inside[:-1]]
        first, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        total = np.r_[0.0, np.cumsum(cost)]
        own = total[end + 1] - total[first]
        text = np.searchsorted(strings.starts, first, "right") - 1
        outside = np.bincount(np.repeat(np.arange(len(texts)), strings.sizes), np.where(inside | before, 0.0, cost), len(texts))
        return outside, text, own, self.ends[code[end]]


def mixture(bits: np.ndarray, share: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Bits of tokens: the mixture of their bytes and of their share of all words, each with what follows."""
    return -np.logaddexp2(np.log2(1 - WORD_SHARE) - bits, np.log2(np.maximum(WORD_SHARE * share * follows, 1e-300)))


def _word_counts(batches):
    """(word, n): partial counts by the word's 64-bit hash."""
    held: Counter = Counter()

    def out():
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held))
        batch = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.fromiter(held.values(), np.int64, len(held)))], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        texts = lowered(batch.column(0).cast(pa.binary()).to_pylist())
        for text in texts:
            held.update(text.split())
        held[b""] += len(texts)
        if len(held) > HELD:
            yield out()
    yield out()


def _numbers(rows):
    for block, numbers in rows:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([numbers.tobytes()], pa.binary())], ["block", "numbers"])


def _summed(batches):
    """(block, numbers) of rows that come sorted by block: the sum of each block; counts become log odds and confidence."""

    def done(block, total):
        if block < 0:
            return total.tobytes()
        zeros, ones = total[::2], total[1::2]
        return odds_of(zeros, ones).astype(np.float16).tobytes() + np.minimum(seen_of(zeros, ones), len(LEVELS) - 1).tobytes()

    last, total = None, None
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            numbers = np.frombuffer(raw, np.float64)
            if block != last:
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([done(last, total)], pa.binary())], ["block", "numbers"])
                last, total = block, np.zeros(len(numbers))
            total = total + numbers
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([done(last, total)], pa.binary())], ["block", "numbers"])


def train(texts: DataFrame) -> Mixer:
    """The byte model of a table (text). What comes to the driver is bounded by the tables' sizes."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = table_bits(size)

    def learned(batches):
        learner = Learner(bits)
        for held in portions(text for batch in batches for text in lowered(batch.column(0).cast(pa.binary()).to_pylist())):
            learner.learn(held)
        yield from _numbers(learner.out())

    # Each task gives back as much as its tables hold, so tasks should take texts worth it.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    parts = texts.select("text").coalesce(tasks).mapInArrow(learned, "block long, numbers binary")
    sums = settled(parts.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block long, numbers binary"), "tables")
    mixer = Mixer(bits)
    for row in sums.toLocalIterator():
        block, raw = row["block"], bytes(row["numbers"])
        if block < 0:
            mixer.settle(np.frombuffer(raw, np.float64))
        else:
            own = slice(block * SLOTS, (block + 1) * SLOTS)
            mixer.odds[own] = np.frombuffer(raw, np.float16, SLOTS)
            mixer.seen[own] = np.frombuffer(raw, np.uint8, SLOTS, 2 * SLOTS)
    return mixer


def scores(docs: DataFrame, fold=None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row, learned where fold holds."""
    spark = docs.sparkSession
    by_batches(spark)
    learned = (docs if fold is None else docs.where(fold)).select("text")
    words = settled(learned.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    end = xxhash.xxh3_64_intdigest(b"")
    end = end - (1 << 64) if end >> 63 else end
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word") != end, F.col("n"))), F.lit(0)).alias("words")).first()
    below, all_words = float(np.log10(size["n"] + size["v"] + 1)), max(1, size["words"])
    frequent = words.orderBy(F.desc("n"), "word").limit(BROADCAST_WORDS).toArrow()
    keys = frequent.column("word").to_numpy().astype(np.int64).view(np.uint64)
    rank = np.argsort(keys)
    mixer = train(learned)
    gc.collect()  # lets Spark delete the shuffle files of settled tables
    shared = spark.sparkContext.broadcast((mixer, keys[rank], frequent.column("n").to_numpy().astype(float)[rank]))

    def scored(batches):
        mixer, known, n = shared.value
        for batch in batches:
            texts = lowered(batch.column(1).cast(pa.binary()).to_pylist())
            tokens, found, base, bits, rare, costs, sizes = [], [], [], [], [], [], []
            for a, b in runs(texts):
                outside, owner, own, follows = mixer.tokens(texts[a:b])
                split = [t.split() for t in texts[a:b]]
                h = np.fromiter((xxhash.xxh3_64_intdigest(w) for s in split for w in [*s, b""]), np.uint64)
                where = np.repeat(np.arange(b - a), [len(s) + 1 for s in split])
                word = np.ones(len(h), bool)
                word[np.cumsum([len(s) + 1 for s in split]) - 1] = False  # the end marks
                hit = np.zeros(len(h), bool)
                count = np.zeros(len(h))
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    count = np.where(hit, n[at], 0.0)
                tokens.append(np.bincount(where, minlength=b - a))
                found.append(np.bincount(where[hit], minlength=b - a))
                base.append(np.bincount(where[hit], np.log10(count[hit] + 1), b - a))
                mixed = mixture(own, count[word] / all_words, follows)
                here = hit[word]
                bits.append(outside + np.bincount(owner[here], mixed[here], b - a))
                # Words that do not stand here: their cost by bytes, and of what follows, waits for their counts.
                cost = np.zeros(len(h))
                cost[word] = own
                after = np.ones(len(h))
                after[word] = follows
                rare.append(h[~hit].view(np.int64)), costs.append(np.stack([cost[~hit], after[~hit]])), sizes.append(np.bincount(where[~hit], minlength=b - a))
            flat = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
            bounds = pa.array(np.r_[0, np.cumsum(flat(sizes, np.int64))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (flat(rare, np.int64), flat([c[0] for c in costs], np.float64), flat([c[1] for c in costs], np.float64))]
            bytes_ = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (flat(tokens, np.int64), flat(found, np.int64), flat(base, np.float64), flat(bits, np.float64), bytes_)), *lists],
                ["doc_id", "n_tokens", "found", "base", "bits", "size", "rare", "cost", "follows"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, found long, base double, bits double, size long, rare array<long>, cost array<double>, follows array<double>"
    rows = settled(docs.select("doc_id", "text").mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    each = rows.select("row", F.explode(F.arrays_zip("rare", "cost", "follows")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.cost", "x.follows")
    known = each.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_bytes = F.log2(F.lit(1 - WORD_SHARE)) - F.col("cost")
    by_word = F.log2(F.lit(WORD_SHARE / all_words) * F.col("n") * F.col("follows"))
    top = F.greatest(by_bytes, by_word)  # a word without count has no by_word
    mixed = F.when(F.col("n") > 0, -(top + F.log2(F.pow(F.lit(2.0), by_bytes - top) + F.pow(F.lit(2.0), by_word - top)))).otherwise(-by_bytes)
    more = known.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("more"),
        F.sum((F.col("n") > 0).cast("long")).alias("times"),
        F.sum(F.when(F.col("word") == end, 0.0).otherwise(mixed)).alias("rest"),
    )
    out = rows.drop("rare", "cost", "follows").join(more, "row", "left")
    bits = F.col("bits") + F.coalesce("rest", F.lit(0.0))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)
    return out.select("doc_id", "n_tokens", (F.col("found") + F.coalesce("times", F.lit(0))).alias("n_known"), F.lit(size["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), (bits * F.lit(-float(np.log10(2)))).alias("score"), (bits / F.col("size")).alias("bits_per_byte"))


def op8_lm(spark, sf_dir: str) -> DataFrame:
    held = crc_of_id(F.col("doc_id"), FOLDS) == HELD_OUT
    found = scores(load(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
