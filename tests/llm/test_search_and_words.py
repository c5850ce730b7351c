"""Ranked search, fingerprints and spelling variants against brute force, and on rows with nulls, ties and repeats."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import fingerprint, ranking, spelling

from ..conftest import rows_of

DOCS = "doc_id long, text string, score string, term string, word string, stretch string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "q") for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def ranked_by_force(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda x: term.findall((x or "").translate(lower))
    counts = [(i, Counter(split(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in counts]
    total, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for place, (i, c) in enumerate(counts):
            score = sum(f * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n[place] * total // words))) for t, f in Counter(split(text)).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, place, i))
        out += [(item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, block", [(ranking.SHARD_POSTINGS, ranking.BLOCK_TERMS), (150, 40), (1, 1000)])
def test_ranking_by_force(spark, shard, block):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(words[min(59, int(rng.exponential(9)))] for _ in range(n))
    docs = [(k // 2 if k % 9 == 0 else k, pick(int(rng.integers(1, 60)))) for k in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " .,!"), (None, docs[3][1]), (None, None), (5, docs[3][1])] + [(2000 + k, "Same WORDS é here") for k in range(30)]
    items = [(k % 8, pick(int(rng.integers(1, 12)))) for k in range(10)] + [(20, None), (21, ""), (22, "unheard"), (23, "É é words same words"), (None, "w1 w1 w59")]
    found = ranking.search(docs_of(spark, docs), items_of(spark, items), shard_postings=shard, block_terms=block).collect()
    assert sorted(map(tuple, found), key=str) == ranked_by_force(docs, items)


def test_ranking_of_empty_tables(spark):
    docs, items = docs_of(spark, [(1, "some words"), (2, "other words"), (3, "words apart")]), items_of(spark, [(1, "some words")])
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    assert ranking.search(docs, items).count() > 0


def test_ranking_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    found = ranking.search(docs, spark.createDataFrame([("q", "two")], "item_id string, text string")).orderBy("rank").collect()
    assert [x["doc_id"] for x in found] == ["a", "b", None]


def test_bounds_stop_early_and_prove_the_best():
    """Shards of documents with a few rare and many frequent terms: the same best as full scores, with fewer postings read."""
    rng = np.random.default_rng(7)
    many = 3000
    lists = [sorted({*(f"f{int(x)}" for x in rng.integers(0, 12, 6)), *(f"r{int(x)}" for x in rng.integers(0, 900, 2))}) for _ in range(many)]
    counts = [[int(x) for x in rng.integers(1, 4, len(x))] for x in lists]
    row = ranking.shard_of(list(range(many)), lists, counts, [sum(c) for c in counts], many, sum(map(sum, counts)))
    shard = ranking.Shard({k: v if k == "vocabulary" else np.asarray(v) for k, v in row.items()})
    calls = []
    whole = shard._whole
    shard._whole = lambda docs, terms: (calls.append(len(docs)), whole(docs, terms))[1]
    for trial in range(40):
        asked = [(f"r{int(x)}", 9000) for x in rng.integers(0, 900, 3)] + [(f"f{j}", int(rng.integers(1, 900))) for j in range(12)]
        asked = list(dict(asked).items())
        full = np.zeros(many, np.int64)
        for t, f in asked:
            if t in shard.terms:
                at = np.flatnonzero(shard.doc_terms == shard.terms[t])
                np.add.at(full, np.searchsorted(shard.doc_ends, at, "right") - 1, f * shard.doc_impacts[at])
        k = (1, 5, 10)[trial % 3]
        order = np.lexsort((np.arange(many), -full))[:k]
        docs, scores = shard.best(asked, k)
        assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    assert len(calls) > 10 and max(calls) <= 10 + ranking.SLACK


# Fingerprints


def level_by_force(symbols):
    """One level of the parsing, symbol by symbol: phrases as tuples of (symbol, run length)."""
    if len(symbols) == 1:
        return symbols
    runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
    mix = lambda x: int(fingerprint.mixed64(np.array([x % 2**64], np.uint64))[0])
    wide = max(symbols) >= 2**32
    step = int(fingerprint.STEP)

    def run(s, n):
        if n == 1:
            return s
        h = mix(s * step + n)
        return h if wide else (s | n << 21 if n < 1024 else h >> 33 | 1 << 31)

    x = [run(s, n) for s, n in runs]
    label, width = x, 64 if wide else 32
    for _ in range(4):
        out = []
        for i, s in enumerate(label):
            differ = s ^ (label[i - 1] if i else s ^ 1)
            k = (differ & -differ).bit_length() - 1 if differ else width
            out.append(2 * k + (s >> k & 1))
        label, width = out, 8
    starts = [0, *(i for i in range(1, len(x) - 1) if label[i] > label[i - 1] and label[i] > label[i + 1])]
    names = []
    for a, b in itertools.pairwise([*starts, len(x)]):
        h = sum(s * pow(fingerprint.BASE, i, 2**64) for i, s in enumerate(x[a:b])) % 2**64
        names.append(mix(h ^ ((b - a) * step % 2**64)))
    return names


def fingerprint_by_force(text):
    if not text:
        return ""
    symbols, parts = list(map(ord, text)), []
    with np.errstate(over="ignore"):
        for level in range(1, 5):
            symbols = level_by_force(symbols)
            if level >= 2:
                parts.append("".join(f"{h:08x}" for h in sorted({int(fingerprint.mixed64(np.array([s], np.uint64))[0]) >> 32 for s in symbols})[: fingerprint.SKETCH]))
    return "-".join(parts)


TEXTS = ["a", "ab", "aaaa", "aaaaab", "a" * 5000 + "b", "hello  world, hello  world", "日本語のテキスト" * 9, "x\u0000y 😀😀 z", " \n", "The same sentence stands here. " * 40]


def test_fingerprints_by_force(spark, duck):
    texts = TEXTS + [t for (t,) in duck.sql("SELECT text FROM documents WHERE length(text) < 2500 ORDER BY doc_id LIMIT 25").fetchall() if t]
    assert [fingerprint.written(x) for x in fingerprint.sketches(texts)] == [fingerprint_by_force(t) for t in texts]


def test_equal_substrings_share_their_interior():
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    passage = "".join(rng.choice(letters, 600))

    def names(text, level=3):
        symbols, starts = np.array(list(map(ord, text)), np.uint32), np.array([0])
        with np.errstate(over="ignore"):
            for _ in range(level):
                symbols, starts = fingerprint.phrases(symbols, starts)
        return symbols.tolist()

    base = names(passage)
    for k in range(1, 60, 7):
        other = set(names("".join(rng.choice(letters, k)) + passage + "".join(rng.choice(letters, 3 * k))))
        assert set(base[8:-8]) <= other


def pairs_by_force(rows):
    order = sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]), reverse=True)
    texts = [(i, t or "") for _, (i, t) in order]
    out = []
    for (i, t), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        third = len(t) // 3
        changed = t[: len(t) - third] + following[:third]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprint_by_force(t), fingerprint_by_force(changed)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [fingerprint.STRETCH_CHARS, 40])
def test_next_documents(spark, monkeypatch, chars):
    monkeypatch.setattr(fingerprint, "STRETCH_CHARS", chars)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, None), (None, "nameless text"), (3, "again three"), (3, "again three"), (50, None), (51, ""), (-7, "below zero")]
    docs = docs_of(spark, rows).coalesce(1)
    found = fingerprint.next_edited(docs).collect()
    assert sorted([tuple(x)[:5] for x in found], key=str) == pairs_by_force(rows)
    for x in found:
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
    assert fingerprint.next_edited(docs.limit(0)).count() == 0
    (lone,) = fingerprint.next_edited(docs_of(spark, [(1, "only one text in here")])).collect()
    assert lone["near_next"] == 1.0 and lone["doc_id"] == 1


def test_likeness():
    (a, b, c, none) = fingerprint.sketches(["one two three four five six seven " * 3, "one two three four five six seven " * 3, "0123456789" * 30, ""])
    assert fingerprint.likeness(a, b) == 1 and fingerprint.likeness(a, c) == 0 and fingerprint.likeness(none, none) == 1 and fingerprint.likeness(a, none) == 0
    assert fingerprint.written(fingerprint.read(fingerprint.written(a))) == fingerprint.written(a)


def test_fingerprint_query_tells_edits_from_others(spark, sf_dir):
    found = fingerprint.op12_fingerprint(spark, sf_dir).where("n_chars > 300")
    n, near, far, unlike = found.agg(F.count(F.lit(1)), F.avg("near_edited"), F.avg("near_next"), F.count_if(F.col("near_edited") < 0.3)).first()
    assert n > 100 and near > 0.55 and far < 0.15 and unlike < 0.02 * n


# Spelling variants


def variants_by_force(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in docs:
        for run, k in Counter(x.translate(lower) for x in re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += k
    n = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, many = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        many[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], many[w], n[form[w]] if form[w] else None) for w in n), key=str)


def test_variants_by_force(spark):
    rng = np.random.default_rng(11)
    base = ["abcdefg", "banana", "letters", "éàçüöäÿ", "mississippi", "aaaaaa", "x" * 70 + "y", "bananas"]
    docs = []
    for k in range(400):
        w = base[int(rng.integers(len(base)))]
        for _ in range(int(rng.choice([0, 0, 0, 1, 1, 2, 3]))):
            at = int(rng.integers(len(w)))
            w = w[:at] + ("", "e", w[at] * 2)[int(rng.integers(3))] + w[at + 1 :]
        docs.append((k // 3, " ".join([w.upper() if k % 5 == 0 else w] * int(rng.choice([1, 3, 5, 30, 400])))))
    docs += [(None, "banana banana banana banana banana bananá"), (None, None), (1, ""), (2, "łódźłódź 12 ×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷")]
    found = spelling.variants(docs_of(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = variants_by_force(docs)
    assert sorted(map(tuple, found), key=str) == expected
    assert any(x[1] for x in expected) and any(x[2] not in (x[0], x[1]) for x in expected) and any(len(x[0]) > 64 and x[4] for x in expected)


def test_long_runs_and_hot_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = [(k, "common words " * 50 + "z" * 3000) for k in range(20)] + [(100 + k, "z" * 2999) for k in range(6)]
    found = {x["word"]: x for x in spelling.variants(docs_of(spark, docs)).collect()}
    assert found["z" * 2999]["n_near"] == 1 and found["common"]["n"] >= 900
    assert spelling.variants(docs_of(spark, docs).limit(0)).count() == 0


def test_spelling_on_the_next_table(spark, duck):
    """The same rows as in SQL on the table of 1,000 documents too, where words are worn."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    assert rows_of(spelling.op13_spelling(spark, "/root/testdata/sf0.01").toPandas()) == rows_of(con.sql(spelling.OP13_SQL).df())
