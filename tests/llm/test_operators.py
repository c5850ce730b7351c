"""The corpus operators against brute force, round trips, held-out accuracy, and rows with nulls, ties and repeats."""

import itertools
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import chat, decontam, hnsw, langid, licenses, lm, minhash, mixing, queries, toxicity, warc

from ..conftest import rows_of

DOCS = "doc_id long, text string, lang string, source string, component_id string, score string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert rows_of(found) == rows_of(duck.sql(queries.SQL[name]).df())


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns whose names the operators use themselves."""
    words = [f"w{i}" for i in range(40)]
    text, near = " ".join(words), " ".join([*words[:39], "other"])
    rows = [(1, text), (2, text), (2, text), (3, near), (4, None), (5, ""), (6, "two words"), (7, "two words"), (None, text), (None, None), (8, "MIT License. " * 3000), (9, " \t\n"), (9, "you are not a clown")]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 else "s", "x", "y") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components_by_force(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_by_force(spark, sf_dir, documents):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1_minhash(spark, sf_dir).collect()}
    assert found == components_by_force(zip(documents.doc_id, documents.text, strict=True))


def test_shingles_of_texts_that_are_worked_on_together(documents, monkeypatch):
    """As many as the definition gives, and the same whatever stands beside a text."""
    texts = [b"", b" \n", b"One", b"one two\x0bthree FOUR", b"a b c d e", b"a b c d e " * 9, *(t.encode() for t in documents.text[:60]), b"one", b""]
    plain = [x.lower().split() for x in texts]
    count = [len({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))}) if x else 0 for x in plain]
    with np.errstate(over="ignore"):
        alone = [minhash.shingles([x])[0] for x in texts]
        for together in (1 << 20, 1, 700):
            monkeypatch.setattr(minhash, "TOGETHER", together)
            found = minhash.shingles(texts)
            assert [len(x) for x in found] == count
            assert all(x.dtype == np.uint64 and np.array_equal(x, y) and (x[1:] > x[:-1]).all() for x, y in zip(found, alone, strict=True))
        assert minhash.shingles([]) == [] and len(np.unique(np.concatenate(alone[3:6]))) == 1 + 5


def test_near_duplicates_that_only_a_middle_one_links(spark):
    """A base and copies with edits of their own: copies are linked to the base alone; and a chain of edits."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        words = base.copy()
        words[int(rng.integers(5, 115))] = f"x{k}"
        words[int(rng.integers(5, 115))] = f"y{k}"
        rows.append((k, " ".join(words)))
    chain = [f"c{i}" for i in range(120)]
    for k in range(100, 130):
        chain[(7 * k) % 110 + 5] = f"z{k}"
        chain[(11 * k) % 110 + 5] = f"q{k}"
        rows.append((k, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == components_by_force(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()]
    assert len(found) == odd.count()
    assert {x for x in found if x[0] in (1, 2, 3)} == {(1, 36, 1, True), (2, 36, 1, False), (3, 36, 1, False)}
    assert (4, 0, 4, True) in found and (5, 0, 5, True) in found and (6, 1, 6, True) in found and (7, 1, 6, False) in found
    assert (None, 36, 1, False) in found and (None, 0, None, False) in found
    assert minhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in minhash.deduplicated(odd).collect()]
    assert kept.count(None) == 1 and sorted(x for x in kept if x is not None) == [1, 4, 5, 6, 8, 9, 9]


def test_near_duplicates_without_ids(spark):
    """Rows without ids, and rows that share one, are told apart by their place."""
    base = " ".join(f"n{i}" for i in range(40))
    rows = [(None, base), (None, base + " more"), (5, "one two three four five six seven"), (5, base), (None, "quite another text of its own here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"][:3]) for r in minhash.deduplicated(docs).collect())
    assert kept == [("5", "n0 "), ("5", "one"), ("None", "qui")]


def test_blocks_cover_all_pairs(monkeypatch, spark, sf_dir, documents):
    """Tiny blocks, and buckets that are cut, change nothing."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "CUT_OVER", 2)
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1_minhash(spark, sf_dir).collect()}
    assert found == components_by_force(zip(documents.doc_id, documents.text, strict=True))


def test_licences_of_odd_rows(odd, none):
    found = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert licenses.scan(odd).count() == odd.count()
    assert (found[8]["n_base"], found[8]["first_word"], found[8]["last_word"], found[8]["base_labels"]) == (3000, 0, 5998, "mit")
    assert (found[4]["n_words"], found[4]["labels"], found[4]["score"]) == (0, "", 0.0)
    assert licenses.scan(none).count() == 0


def test_licence_needs_its_words_in_a_row(spark):
    docs = spark.createDataFrame([(1, "apache: license"), (2, "license apache"), (3, "Licensed under the Apache License, Version 2.0."), (4, "general public mit license")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_base"], r["labels"]) for r in licenses.scan(docs).collect()}
    assert found == {1: (1, "apache"), 2: (0, ""), 3: (1, "apache,apache-2.0"), 4: (1, "mit")}


def test_licence_notices(spark):
    """Notices match by most of their words around the key phrase, wherever they stand; a key phrase alone does not."""
    notice = next(t[1] for t in licenses.TEMPLATES if t[0] == "isc" and "fee" in t[1])
    worn = " ".join(w for i, w in enumerate(notice.split()) if w != "purpose" or i < 3)
    docs = spark.createDataFrame([(1, f"# x\n{notice.upper()}."), (2, "with or without fee is hereby granted"), (3, worn.replace("copy modify", "COPY, modify"))], "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licenses.scan(docs).collect()}
    assert found[1] == ("isc", 0) and found[2][1] == 0 and "isc" in found[3][0]


def test_nearest_neighbours(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    found = hnsw.op3_hnsw(spark, sf_dir).toPandas()
    vectors, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hits = 0
    for q, own in found.groupby("query_id"):
        at = np.flatnonzero(ids == q)[0]
        score = vectors @ vectors[at]
        score[at] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, score[[np.flatnonzero(ids == v)[0] for v in own.vec_id]])
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_shards_are_merged(spark, sf_dir):
    """Many small shards: recall against brute force after merging, and pairs over many tasks."""
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    found = hnsw.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, shard_rows=60).toPandas()
    vectors, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hits = 0
    for q, own in found.groupby("query_id"):
        score = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(own.vec_id))
    assert hits >= 0.95 * 20 * (ids % 20 == 0).sum()
    assert hnsw.shard_size(1000, 64) == 8192 and hnsw.shard_size(10**7, 64) < hnsw.shard_size(10**7, 8) and hnsw.shard_size(10**12, 64) == hnsw.shard_size(10**10, 64)


def test_neighbours_of_odd_vectors(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 60)] + [(60, [0.0, 0.0]), (61, None), (62, [1.0, None]), (63, [float("nan"), 1.0]), (64, [9.0, 9.0]), (None, [5.0, 5.0]), (40, same), (80, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = hnsw.neighbours(table, F.col("vec_id") % 20 == 0).toPandas()
    assert set(found.query_id) == {0, 20, 40}
    first = found[found.query_id == 20].sort_values("rank")
    assert first.vec_id.iloc[0] == 64 and pd.isna(first.vec_id.iloc[1]) and first.vec_id.iloc[2:].astype(int).tolist() == [*range(0, 18)]
    assert hnsw.neighbours(table.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_large_shards_find_their_neighbours():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    vectors = centres[rng.integers(0, 12, 4000)] + 0.4 * rng.normal(size=(4000, 24))
    graph = hnsw.Graph.build(np.arange(4000), vectors, float(np.sqrt((vectors**2).sum(axis=1).max())))
    graph = hnsw.Graph.of(graph.row())
    found, scores = graph.search(vectors[:200], 10)
    best = np.argsort(-(vectors[:200] @ vectors.T), axis=1)[:, :10]
    assert sum(len(set(a) & set(b)) for a, b in zip(found, best, strict=True)) >= 0.93 * 2000


def test_toxicity_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    found = toxicity.op4_toxicity(spark, sf).toPandas().set_index("doc_id")
    assert (found.held_out == found.index.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    docs = docs.join(found, on="doc_id")
    held = docs[docs.held_out]
    insulted = held.text.str.contains(r"\b(?:" + "|".join(toxicity.INSULT) + r")\b", case=False)
    assert (held.predicted == held.toxic).mean() >= 0.9
    assert (held[insulted & (held.toxic == 1)].predicted == 1).all()
    assert (held[~insulted].predicted == 0).all()


def clauses_by_rule(tokens, lexicon):
    """Weights of the matched clauses by looking back from each word, without machines."""
    t = toxicity
    found = []
    for clause in "\n".join(x if x[0] not in ".!?;\n" else "\n" for x in tokens).split("\n\n"):
        kinds = [lexicon.get(w, (t.OTHER, 0.0)) for w in clause.split("\n") if w]
        kind = [k for k, _ in kinds]
        total = 0.0
        for i, (k, weight) in enumerate(kinds):
            says, no = t.SAYS in kind[max(0, i - t.SAYS_REACH) : i], t.NOT in kind[max(0, i - t.NOT_REACH) : i]
            calm = (t.QUOTED if says else 1) * (t.DENIED if no else 1)
            if k in (t.BAD, t.DANGER):
                aimed = t.AIMED if t.WHOM in kind[max(0, i - t.TARGET_REACH) : i] else 1
                total += weight * (t.THREATENS if k == t.DANGER else 1) * (t.SECOND if k in kind[:i] else 1) * aimed * calm
            elif k == t.WHOM and {t.BAD, t.DANGER} & set(kind[max(0, i - t.AFTER_REACH) : i]):
                total += weight * calm
        if total:
            found.append(total)
    return found


def test_toxicity_by_force(spark, sf_dir):
    """Every score equals that of rules applied word by word, with the fitted model."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    lexicon, w = toxicity.classes_of(model.weights), model.coefficients
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored_by(model, docs).collect()}
    extra = ["idiot, you", "you said he is not an idiot. kill them", "you you kill the idiot you", "he said: you moron"]
    for text, score in [*((texts[i], scores[i]) for i in texts), *zip(extra, model.scores()(extra)[0], strict=True)]:
        tokens = toxicity.TOKEN.findall((text or "").lower())
        total = sum(clauses_by_rule(tokens, lexicon))
        x = [np.floor(min(np.log1p(v), 6) * 8) / 8 for v in (total, 100 * total / max(1, len(tokens)))]
        assert np.isclose(score, 1 / (1 + np.exp(-(w[0] + w[1] * x[0] + w[2] * x[1]))), atol=1e-6)


def test_few_labelled_rows_are_enough(spark, sf_dir):
    """The bound on labelled rows holds, and the same rows are drawn each time."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    one, two = (toxicity.train(docs, labels.repartition(n), 40) for n in (1, 5))
    assert one.weights == two.weights and np.allclose(one.coefficients, two.coefficients)


def test_toxic_clauses():
    lexicon, machine = toxicity.classes_of({"idiot": 4.0}), toxicity.grammar()
    weigh = lambda t: sum(toxicity.clauses(toxicity.TOKEN.findall(t.lower()), lexicon, machine))
    assert weigh("you idiot") > weigh("an idiot") > weigh("he said an idiot") > weigh("he said not an idiot") > 0
    assert weigh("idiot, you") > weigh("idiot")
    assert weigh("nothing here. at all") == weigh("you there") == 0
    assert weigh("idiot. idiot") < weigh("idiot idiot")


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 1), (8, None), (99, 1), (6, 0), (6, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns


def test_language_held_out(spark, sf_dir, documents):
    found = langid.op5_langid(spark, sf_dir).toPandas().set_index("doc_id")
    joined = documents.join(found, on="doc_id")
    held = joined[joined.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95
    assert joined.rejected.mean() < 0.02


def test_kneser_ney_sums_to_one():
    keys, _ = langid.grams(["abac abad", "cab"])
    own, counts = np.unique(keys, return_counts=True)
    model = langid.KneserNey(own, counts.astype(float))
    letters = np.array(sorted({int(k) & 0xFFFF for k in own}), np.uint64)
    for context in np.unique(own >> np.uint64(16)):
        seen = model.probability((context << np.uint64(16)) | letters).sum()
        unseen = model.probability((context << np.uint64(16)) | np.array([0x7FFF], np.uint64))[0]
        assert abs(seen + unseen * (langid.ALPHABET - len(letters)) - 1) < 1e-9


def test_language_of_odd_rows(odd, none):
    found = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert found[4]["lang_pred"] == "und" and found[4]["rejected"] and found[5]["lang_pred"] == "und" and found[1]["lang_pred"] == "en"
    assert langid.identify(none).count() == 0
    assert langid.with_known_language(none).count() == 0


def filled(sizes):
    """Targets by water-filling in rounds, for source -> words: the independent way to mixing.targets."""
    weights = dict(zip(sorted(sizes), itertools.cycle((5.0, 2.0, 1.0)), strict=False))
    found, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] < weights[s] * level}
        if not over:
            return found | {s: weights[s] * level for s in open_}
        found |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return found


def test_mixing(spark, sf_dir, documents):
    found = mixing.op6_mixing(spark, sf_dir).toPandas().merge(documents[["doc_id", "source"]], on="doc_id")
    assert (found.taken <= 3 * found["size"]).all() and (found.taken % found["size"].clip(lower=1) == 0).all()
    expected = filled(found.groupby("source")["size"].sum().to_dict())
    for source, own in found.groupby("source"):
        assert np.allclose(own.target, expected[source], atol=1e-3)
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 3 * own["size"].max()


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 1000, "c": 1000, "d": 1000}, {"a": 500, "b": 200}, {"a": 50, "b": 20, "c": 10, "d": 50, "e": 0}, {"a": 10, "b": 1000, "c": 1000, "d": 10}])
def test_mixing_of_equal_ratios(spark, duck, sizes):
    """Sources of equal cap to weight: targets by water-filling, in Spark and in SQL, and they sum to all words."""
    rows = [(k * 10_000 + i, s, "w " * 10) for k, (s, n) in enumerate(sorted(sizes.items())) for i in range(n // 10)] + [(99, "e", "")] * ("e" in sizes)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(docs).toPandas()
    expected = filled(sizes)
    assert np.allclose(found.target, found.source.map(expected)) and (found.taken <= 3 * found["size"]).all()
    assert np.isclose(sum(expected.values()), sum(sizes.values()))
    for source, own in found.groupby("source"):
        assert abs(own.taken.sum() - expected[source]) <= 30
    own = duckdb.connect()
    own.register("documents", pd.DataFrame(rows, columns=["doc_id", "source", "text"]))
    sql = own.sql(mixing.OP6_SQL).df()
    assert sorted(zip(sql.doc_id, sql.target, sql.taken, strict=True)) == sorted(zip(found.doc_id, found.target.round(4), found.taken, strict=True))


def test_mixing_of_odd_rows(spark, odd, none):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count() and sum(r["size"] for r in found) >= sum(r["taken"] for r in found) > 0
    assert mixing.mix(none).count() == 0
    kept = mixing.taken_rows(odd.withColumn("size", F.lit("own"))).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in kept) == sorted((str(r["doc_id"]), r["taken"]) for r in found if r["taken"])
    nameless = spark.createDataFrame([(None, "one two", "s")] * 3 + [(1, "three", "s")], "doc_id long, text string, source string")
    assert sum(r["taken"] for r in mixing.taken_rows(nameless).collect()) == 7


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "B"), (3, 0, None, None), (None, 0, "user", "x")]
    table = spark.createDataFrame([(*t, "p") for t in turns], "conv_id long, turn long, role string, text string, pair_id string")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 1), (12, 3, 7)], "pair_id long, chosen_id long, rejected_id long")
    found = {r["pair_id"]: r for r in chat.preferences(pairs, table).collect()}
    r = found[10]
    assert (r["prefix_turns"], r["prompt"]) == (1, "<|im_start|>user\na<|im_end|>\n")
    a, b = map(int, r["chosen_mask"].split("-"))
    assert r["chosen"][a:b] == "b<|im_end|>" and r["rejected"].startswith("<|im_start|>assistant\nB")
    own = {r["pair_id"]: r for r in chat.preferences(*chat.with_rejected(table)).collect()}
    assert own[1]["prefix_turns"] == 1 and "<|im_start|>assistant\nB<" in own[1]["rejected"] and own[1]["chosen"].startswith("<|im_start|>assistant\nb")
    assert (own[2]["prefix_turns"], own[2]["rejected"]) == (1, "") and own[3]["prefix_turns"] == 1 and own[3]["chosen"] == ""
    assert found[11]["prefix_turns"] == 3 and found[11]["chosen"] == found[11]["rejected"] == ""
    assert found[12]["chosen"] == "<|im_start|>unknown\n<|im_end|>\n" and found[12]["rejected"] == ""
    assert chat.preferences(pairs.limit(0), table).count() == 0


def test_language_model(spark, sf_dir, documents):
    found = lm.op8_lm(spark, sf_dir).toPandas().set_index("doc_id")
    held = documents.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    tokens = [[*t.encode().lower().split(), b""] for t in documents.text]
    counts = pd.Series([w for t, h in zip(tokens, held, strict=True) if not h for w in t]).value_counts()
    n, v = counts.sum(), len(counts)
    counts = counts.to_dict()
    for i, t in zip(documents.doc_id, tokens, strict=True):
        c = [counts.get(w, 0) for w in t]
        r = found.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x > 0 for x in c), n)
        assert np.isclose(r.base_score, sum(np.log10((x + 1) / (n + v + 1)) for x in c), rtol=1e-9)
    bits = -found.score.to_numpy() / np.log10(2) / (documents.set_index("doc_id").text.map(lambda t: len(t.encode()) + 1).loc[found.index])
    assert bits[found.held_out].mean() < 3.2


def learned(texts, bits=(18, 18, 18, 18, 18)):
    """The model of some texts, without Spark."""
    learner = lm.Learner(list(bits))
    for a, b in lm.runs(texts):
        learner.learn(texts[a:b])
    rows = sorted(((block, numbers) for block, numbers in learner.out()), key=lambda x: x[0])
    model = lm.Mixer(list(bits))
    for batch in lm._summed(lm._numbers(rows)):
        block, raw = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        if block < 0:
            model.settle(np.frombuffer(raw, np.float64))
        else:
            own = slice(block * lm.SLOTS, (block + 1) * lm.SLOTS)
            model.odds[own], model.seen[own] = np.frombuffer(raw, np.float16, lm.SLOTS), np.frombuffer(raw, np.uint8, lm.SLOTS, 2 * lm.SLOTS)
    return model


def bits_by_force(model, text):
    """Bits of each byte of one text, one decision after the other, by plain Python."""
    weights, refined = model.weights.astype(float).copy(), model.refined.astype(float).copy()
    curved, swayed = np.zeros((lm.GATES, lm.INPUTS)), np.zeros(lm.BUCKETS)
    found, pending, step = [], [], 0
    for i, code in enumerate([*text, 0]):
        now = int(lm.step_of(np.array([i]))[0])
        if now != step:
            sums = [np.zeros_like(x) for x in (weights, curved, refined, swayed)]
            for gate, bucket, odds, error, bent in pending:
                sums[0][gate] += error * odds
                sums[1][gate] += bent * odds**2
                sums[2][bucket] += error
                sums[3][bucket] += bent
            curved += sums[1]
            swayed += sums[3]
            weights += sums[0] / (lm.OWN_PULL + lm.INPUTS * curved)
            refined += sums[2] / (lm.REFINE_PULL + 2 * swayed)
            pending, step = [], now
        start = i
        while start > 0 and text[start - 1] not in b" \t\n\x0b\x0c\r":
            start -= 1
        word = sum((b + 1) * pow(lm.FACTOR, k, 1 << 64) for k, b in enumerate(text[start:i])) % (1 << 64)
        before = sum(b << 8 * k for k, b in enumerate(reversed(text[max(0, i - 6) : i])))
        slots = lm.slots_of(model.bits, np.array([code], np.uint8), np.array([before], np.uint64), np.array([word], np.uint64))[:, :, 0]
        gate = int(lm.gates_of(model.seen[slots[:, 0]][:, None])[0])
        bits = 0.0
        for j in range(8):
            odds = model.odds[slots[:, j]].astype(float)
            x = weights[gate] @ odds
            bucket = int(np.rint(np.clip(x, -8, 8) + 8))
            p = 1 / (1 + np.exp(-np.clip(x + refined[bucket], -20, 20)))
            bit = code >> (7 - j) & 1
            bits -= np.log2(p if bit else 1 - p)
            pending.append((gate, bucket, odds, bit - p, p * (1 - p)))
        found.append(bits)
    return found


def test_bits_by_force(documents):
    """Each byte's bits equal those of a bit by bit coder, whichever texts are coded together."""
    texts = [t.encode().lower() for t in documents.text[:40]]
    model = learned(texts)
    asked = [texts[0][:3000], b"", texts[3][:700], b"qzx \0 qzx", b" \t\n"]
    cost, strings = model.bits_of(asked)
    for text, start, size in zip(asked, strings.starts, strings.sizes, strict=True):
        assert np.allclose(cost[start : start + size], bits_by_force(model, text), rtol=1e-3, atol=1e-3)


def test_bits_are_a_distribution(documents):
    """Over all bytes that may follow, probabilities sum to one."""
    texts = [t.encode().lower() for t in documents.text[:20]]
    model = learned(texts)
    for start in (b"", b"th", b"the zq"):
        ends = [model.bits_of([start + bytes([b])])[0][len(start)] for b in range(256)]
        assert abs(np.exp2(-np.array(ends)).sum() - 1) < 1e-3


def test_scores_by_force(spark, sf_dir, monkeypatch):
    """Scores equal the sum over tokens of the mixture of bytes and words, however few words stand in each task."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    own = docs.toPandas()
    texts = [(t or "").encode().lower() for t in own.text]
    kept = []
    monkeypatch.setattr(lm, "train", lambda rows, train=lm.train: kept.append(train(rows)) or kept[-1])
    counts = pd.Series([w for t in texts for w in t.split()]).value_counts()
    for most in (400_000, 50):
        monkeypatch.setattr(lm, "BROADCAST_WORDS", most)
        found = {r["doc_id"]: r["score"] for r in lm.scores(docs).collect()}
        for i, text in zip(own.doc_id, texts, strict=True):
            cost = kept[-1].bits_of([text])[0]
            total, at = 0.0, 0
            for word in text.split():
                first = text.index(word, at)
                total += cost[at:first].sum()
                end = first + len(word)
                follows = text[end] if end < len(text) else 0
                by_bytes = 2.0 ** -cost[first : end + 1].sum() * (1 - lm.WORD_SHARE)
                total -= np.log2(by_bytes + lm.WORD_SHARE * counts[word] / counts.sum() * kept[-1].ends[follows])
                at = end + 1
            total += cost[at:].sum()
            assert np.isclose(found[i], -total * np.log10(2), rtol=1e-4), i


def test_better_than_the_base(spark, sf_dir):
    """On held-out rows the model's total is above the base's."""
    found = lm.op8_lm(spark, sf_dir.replace("sf0.001", "sf0.1")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_mixer_learns_on_little_text(documents):
    """Weights move on a task's few KB, and held-out text then costs less than with the first weights."""
    held = documents.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    train, test = ([t.encode().lower() for t in documents.text[x]] for x in (~held, held))
    assert [sum(map(len, p)) + len(p) for p in lm.portions([b"x" * 99] * 300)] == [4100, 8200, 16400, 1300]
    parts = [lm.Learner([18] * 5) for _ in range(4)]
    for k, learner in enumerate(parts):
        for texts in lm.portions(train[k::4]):
            learner.learn(texts)
        assert np.abs(learner.weights - lm.FIRST).max() > 0.05
    counts, last = sum(p.counts.astype(float) for p in parts), sum(list(p.out())[-1][1] for p in parts)
    cost = []
    for settle in (False, True):
        mixer = lm.Mixer([18] * 5)
        mixer.odds, mixer.seen = lm.odds_of(counts[::2], counts[1::2]).astype(np.float16), np.minimum(lm.seen_of(counts[::2], counts[1::2]), 255)
        if settle:
            mixer.settle(last)
        cost.append(mixer.bits_of(test)[0].sum())
    assert cost[1] < 0.99 * cost[0]


def test_language_model_of_odd_rows(odd, none):
    found = {r["doc_id"]: r for r in lm.scores(odd).collect()}
    assert len(lm.scores(odd).collect()) == odd.count()
    assert found[4]["n_tokens"] == found[5]["n_tokens"] == 1 and found[4]["score"] == found[5]["score"] < 0
    assert lm.scores(none).count() == 0


def test_decontamination(spark, sf_dir, documents):
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    expected = {i for i, t in zip(documents.doc_id, documents.text, strict=True) if any(plain(x) in plain(t) for x in items.text)}
    found = decontam.op9_decontamination(spark, sf_dir).where("contaminated").collect()
    assert {r["doc_id"] for r in found} == expected


def test_reparameterised_questions(spark, odd):
    item = "Alice has 12 apples and gives 5 km of rope to Bob before 12 more apples arrive at the house near the river"
    other = item.replace("12", "40").replace("5 km", "7 miles").replace("Bob", "John Smith")
    mixed = item.replace("12 apples", "40 apples").replace("12 more", "13 more")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before. {other}. After"), (2, mixed), (3, "Nothing of that kind is in here at all"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["leak"]["n_items"] for r in decontam.flagged(docs, bench).collect()}
    assert found[1] > 0 and found[2] == 0 and found[3] == 0 and found[4] == 0
    assert decontam.decontaminated(odd, bench.limit(0)).count() == odd.count()


def leaks_by_force(docs, items):
    """row -> items: every window of every item is looked for in every text, without hashes, rarity or joins."""

    def cut(text):
        words, at, tokens = decontam.template(text, decontam.Memory())
        n = min(decontam.WORDS, len(words))
        return words, at, tokens, [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []

    out = {}
    known = [(i, *cut(t)) for i, t in items]
    for row, text in enumerate(docs):
        words, at, tokens, own = cut(text)
        for item, iwords, iat, itokens, theirs in known:
            both = [(d, p) for p, w in enumerate(theirs) if theirs.index(w) == p for d, x in enumerate(own) if x == w]
            if not theirs or 100 * len({p for _, p in both}) < decontam.LEAST * len(set(theirs)):
                continue
            places = {}
            for d, p in {(d + j, p + j) for d, p in both for j in range(decontam.WORDS)}:
                if p < len(iwords) and d < len(words) and (v := decontam.slot_value(iwords, iat, itokens, p)) is not None:
                    places.setdefault((d - p, v), {})[d] = decontam.slot_value(words, at, tokens, d)
            repeated = [set(v.values()) for v in places.values() if len(v) > 1]
            if sum(len(v) > 1 for v in repeated) <= decontam.MOST_BROKEN * len(repeated):
                out.setdefault(row, set()).add(item)
    return out


def test_leaks_by_force(spark, sf_dir, documents):
    """Items and their counts by document equal those of the plain search, also for ids that are text, null or repeated."""
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet").head(60)
    extra = "Anna paid 12 euros for 3 km of rope and Anna paid 12 euros for 4 km of wire in Bonn"
    bench = [*zip(items.item_id.astype(str), items.text, strict=True), ("x", extra), (None, "short words only"), ("y", ""), ("z", None)]
    texts = [*documents.text[:120], f"So. {extra.replace('12', '77').replace('Anna', 'Bob Lee')}. End", extra.replace("12 euros for 4", "13 euros for 4"), "short words only", None, "", *[t + " tail" for t in items.text[:5]]]
    docs = spark.createDataFrame([("same" if k % 3 else None, t, k, "own") for k, t in enumerate(texts)], "doc_id string, text string, k int, leak string")
    found = {r["k"]: r["leak"]["n_items"] for r in decontam.flagged(docs, spark.createDataFrame(bench, "item_id string, text string")).collect()}
    expected = leaks_by_force(texts, bench)
    assert len(found) == len(texts) and {k: n for k, n in found.items() if n} == {k: len(v) for k, v in expected.items()}
    kept = decontam.decontaminated(docs, spark.createDataFrame(bench, "item_id string, text string"))
    assert kept.columns == docs.columns and {r["k"] for r in kept.collect()} == set(found) - set(expected)


def test_archives_of_odd_pages(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, "http://a", long), (2, "http://b", long), (2, "http://c", long), (3, None, None), (4, "u\r\nv", ""), (5, "x", "short"), (6, "x", "short"), (None, "n", long)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    index = warc.index(spark, path)
    found = warc.read(index).collect()
    assert len(found) == len(rows)
    assert sorted((r["page_id"] or "", r["record_type"], r["refers_to"]) for r in found) == sorted(
        [("1", "response", None), ("2", "revisit", "1"), ("2", "revisit", "1"), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("", "revisit", "1")], key=lambda x: x[:2]
    )
    assert next(r for r in found if r["page_id"] == "1")["payload"].decode() == long
    assert sorted(r["url"] for r in found if r["page_id"] == "2") == ["http://b", "http://c"]
    assert all(r["found_digest"] in (None, r["payload_digest"]) for r in found)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_gzip(spark, tmp_path, monkeypatch):
    """Archives are plain gzip files, whole records of any size come back, also where only Spark can open them."""
    import glob
    import gzip

    pages = spark.createDataFrame([(1, "a", "x" * (17 << 20)), (2, "b", "y" * 200), (3, "c", "y" * 200), (3, "c", "y" * 200)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/g"
    warc.write(pages, path)
    text = b"".join(gzip.open(p).read() for p in glob.glob(f"{tmp_path}/g/*.txt"))
    assert text.count(b"WARC/1.1") == 4 and text.count(b"y" * 200) == 1
    once = sorted((r["page_id"], r["record_type"], r["payload"] and len(r["payload"]), r["refers_to"]) for r in warc.read(warc.index(spark, path)).collect())
    assert [x[:3] for x in once] == [("1", "response", 17 << 20), ("2", "response", 200), ("3", "revisit", None), ("3", "revisit", None)]
    monkeypatch.setattr(warc, "opened", lambda path: None)
    assert sorted((r["page_id"], r["record_type"], r["payload"] and len(r["payload"]), r["refers_to"]) for r in warc.read(warc.index(spark, path)).collect()) == once


def test_archives_that_only_spark_opens(spark, monkeypatch, sf_dir):
    """The same records where archives come as whole files, each one once beside its rows."""
    want = warc.op10_warc(spark, sf_dir).toPandas()
    monkeypatch.setattr(warc, "opened", lambda path: None)
    assert rows_of(warc.op10_warc(spark, sf_dir).toPandas()) == rows_of(want)


def test_schemes_without_a_library():
    assert warc.opened("hdfs://nowhere/x.txt") is None and warc.opened("viewfs://store/x.txt") is None
    with pytest.raises(OSError):
        warc.opened("file:///no/such/archive.txt")


def test_ranges_join_neighbours():
    rows = [(0, 10), (10, 10), (20 + warc.MOST_GAP + 1, 5), (10**9, warc.MOST_SPAN), (10**9 + warc.MOST_SPAN, 5)]
    assert list(warc._ranges(rows)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
