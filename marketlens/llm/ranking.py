"""Ranked lexical search over impact-ordered postings, score at a time.

1. term_counts: one pass over whole texts gives each document its number of terms and, for the terms that a bitmap of
   the asked ones has (8 MB for any number of items), their occurrences.
2. Statistics over all documents: N, L, and the document frequency of every term.
3. impact_index: consecutive documents make a shard of at most SHARD_POSTINGS postings. A shard's postings are grouped
   by term and exact impact, impacts descending, in flat arrays; the documents' own lists stand beside them.
4. search: items go in blocks of bounded size to all shards. For an item, a shard takes the groups of its terms by
   descending contribution (weight times impact) and adds them to accumulators. It stops only when the bounds of what is
   left prove that no document but a few can be among the best k: neither one not met so far (the sum of all terms'
   heads is below the k-th best sum) nor any other one met. The scores of those few are completed from the documents'
   own lists. Without a proof it goes on to the end of the lists. The shards' best are merged by a window that
   keeps k rows a task before its shuffle.

No posting is shuffled; a term of all documents is split over the shards like any other.

Defined cases: null and empty texts have no terms and are not counted in N; an item without terms, or whose terms are
in no document, has no result; rows that repeat an id are documents (or items) of their own, told apart by place; equal
scores go by ascending id, null last, then by place; ids may be of any type; an empty table of either kind gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SIEVE_BITS, bitmap, by_batches, in_bitmap, load, settled

#: Bytes that belong to terms, A-Z in lower case: digits, letters and all that is not ASCII; others part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Results of an item, and the constants of the impact.
BEST, FULL, FLAT, SLOPE, TIMES, SCALE = 10, 100, 75, 8, 1000, 1_000_000_000
#: Postings of a shard at most (unless one document has more), and terms of the items that one block holds.
SHARD_POSTINGS, BLOCK_TERMS = 500_000, 200_000
#: A shard completes scores of at most so many documents beyond the best; while more could be among them it goes on.
SLACK = 64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _hash_place(term: Column) -> Column:
    """The place of a term in the bitmap; _places is its like."""
    return F.shiftrightunsigned(F.xxhash64(term), 64 - SIEVE_BITS)


def _places(terms: list[bytes]) -> np.ndarray:
    """xxh64 with Spark's seed 42 of the UTF-8 bytes, cut like _hash_place."""
    return (np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) for each distinct term of items, which has item_id and text; item tells rows apart."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            rows = [(i, t, n) for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()) for t, n in Counter(terms_of(text or b"")).items()]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["item", "item_id", "term", "times"])

    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(split, f"item long, item_id {kind}, term string, times long")


def term_counts(docs: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """(doc, doc_id, n, terms, counts) for each row of docs with a term; lists hold the terms that the bitmap asked has."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(asked)

    def count(batches):
        bits = known.value
        for batch in batches:
            found = [Counter(terms_of(x or b"")) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            sizes = [sum(c.values()) for c in found]
            terms = [t for c in found for t in c]
            keep = np.ones(len(terms), bool) if bits is None else in_bitmap(bits, _places(terms))
            whose = np.repeat(np.arange(len(found)), [len(c) for c in found])[keep]
            ends = np.append(0, np.cumsum(np.bincount(whose, minlength=len(found)))).astype(np.int32)
            kept = pa.array([t for t, k in zip(terms, keep, strict=True) if k], pa.binary()).cast(pa.string())
            times = pa.array(np.array([n for c in found for n in c.values()], np.int64)[keep])
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (kept, times)]
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], ["doc", "doc_id", "n", "terms", "counts"])
            yield rows.filter(pa.array(np.array(sizes, np.int64) > 0))

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    return rows.mapInArrow(count, f"doc long, doc_id {kind}, n long, terms array<string>, counts array<long>")


#: Columns of a shard, all of them lists: documents by ascending id, the terms, and the arrays that shard_of names.
_SHARD = {"docs": "long", "vocabulary": "string", "term_ends": "long", "impacts": "long", "group_ends": "long", "members": "int", "doc_ends": "long", "doc_terms": "int", "doc_impacts": "long"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def shard_of(docs: list[int], lists: list[list[str]], counts: list[list[int]], n: list[int], total_docs: int, total_terms: int) -> dict:
    """The columns of _SHARD for some documents: groups of (term, exact impact), impacts descending within a term.

    The groups of term t are term_ends[t] to term_ends[t + 1], the members of group g are group_ends[g] to
    group_ends[g + 1]; doc_ends, doc_terms and doc_impacts are the documents' own lists.
    """
    whose = np.repeat(np.arange(len(docs)), [len(x) for x in lists])
    vocabulary: dict[str, int] = {}
    term = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for x in lists for t in x), np.int64, len(whose))
    tf = np.fromiter((c for x in counts for c in x), np.int64, len(whose))
    length = np.array([FULL - FLAT + FLAT * x * total_docs // total_terms for x in n], np.int64)
    impact = SCALE * tf // (TIMES * tf + SLOPE * length[whose])
    order = np.lexsort((whose, -impact, term))
    t, i = term[order], impact[order]
    starts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])))
    return {
        "docs": docs,
        "vocabulary": list(vocabulary),
        "term_ends": np.append(np.searchsorted(t[starts], np.arange(len(vocabulary))), len(starts)),
        "impacts": i[starts],
        "group_ends": np.append(starts, len(t)),
        "members": whose[order].astype(np.int32),
        "doc_ends": np.append(0, np.cumsum([len(x) for x in lists])),
        "doc_terms": term.astype(np.int32),
        "doc_impacts": impact,
    }


def impact_index(counts: DataFrame, total_docs: int, total_terms: int, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row of _SHARD for each shard of counts, as term_counts gives it; documents without any asked term are left out."""
    schema = pa.schema([(name, pa.list_(_ARROW[kind])) for name, kind in _SHARD.items()])

    def build(batches):
        held: list[tuple] = []
        size = 0

        def shard():
            held.sort(key=lambda x: (False, x[1], x[0]) if x[1] is not None else (True, x[0]))
            docs, _, n, lists, times = map(list, zip(*held, strict=True))
            found = shard_of(docs, lists, times, n, total_docs, total_terms)
            return pa.RecordBatch.from_arrays([pa.array([found[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc", "doc_id", "n", "terms", "counts")], strict=True):
                if held and size + len(row[3]) > shard_postings:
                    yield shard()
                    held, size = [], 0
                if row[3]:
                    held.append(row)
                    size += len(row[3])
        if held:
            yield shard()

    return counts.select("doc", "doc_id", "n", "terms", "counts").mapInArrow(build, ", ".join(f"{name} array<{kind}>" for name, kind in _SHARD.items()))


class Shard:
    """One row of the index as arrays."""

    def __init__(self, row: dict):
        self.terms = {t: i for i, t in enumerate(row["vocabulary"])}
        for name in _SHARD:
            setattr(self, name, row[name])
        self.factors = np.zeros(len(self.terms), np.int64)

    def best(self, asked: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of this shard (by place) and their scores, ties to the smaller place.

        asked has (term, factor), the factor being the term's weight times its occurrences in the item.
        """
        terms = sorted(((self.terms[t], f) for t, f in asked if t in self.terms), key=lambda x: -x[1])
        if not terms:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # The groups of all terms by descending contribution; those of one term stay in order.
        spans = [(int(self.term_ends[t]), int(self.term_ends[t + 1])) for t, _ in terms]
        group = np.concatenate([np.arange(a, b) for a, b in spans])
        gives = np.concatenate([self.impacts[a:b] * f for (a, b), (_, f) in zip(spans, terms, strict=True)])
        whose = np.repeat(np.arange(len(terms)), [b - a for a, b in spans])
        order = np.argsort(-gives, kind="stable")
        group, gives, whose = group[order], gives[order], whose[order]
        sizes = self.group_ends[group + 1] - self.group_ends[group]
        so_far = np.append(0, np.cumsum(sizes))

        # Sums so far, and bits of the terms that a document was met with: the first 63 terms, which are those of the
        # largest factors. Bounds of documents are wider for terms beyond, never too narrow.
        low, met = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), np.int64)
        bit = np.where(np.arange(len(terms)) < 63, np.int64(1) << np.minimum(np.arange(len(terms)), 62), 0)
        done, step = 0, max(4 * k, int(so_far[-1]) // 8)
        while True:
            upto = min(len(group), max(done + 1, int(np.searchsorted(so_far, so_far[done] + step))))
            n = sizes[done:upto]
            members = self.members[np.repeat(self.group_ends[group[done:upto]] - so_far[done:upto], n) + np.arange(so_far[done], so_far[upto])]
            np.add.at(low, members, np.repeat(gives[done:upto], n))
            done = upto
            if done == len(group):
                found = np.flatnonzero(low)
                return self._top(found, low[found], k)
            np.bitwise_or.at(met, members, np.repeat(bit[whose[upto - len(n) : upto]], n))
            if np.count_nonzero(low) < k:
                continue
            # What each term can still give: its first group that is left, 0 if none is.
            heads = np.zeros(len(terms), np.int64)
            left, first = np.unique(whose[done:], return_index=True)
            heads[left] = gives[done:][first]
            rest, least = int(heads.sum()), int(np.partition(low, len(low) - k)[len(low) - k])
            if rest >= least:
                continue  # a document not met so far could still be among the best
            able = np.flatnonzero((low > 0) & (low + rest >= least))
            bound = low[able] + rest
            for j in left[left < 63]:
                bound -= np.where(met[able] & bit[j] != 0, heads[j], 0)
            able = able[bound >= least]
            if len(able) <= k + SLACK:
                return self._top(able, self._whole(able, terms), k)

    def _whole(self, docs: np.ndarray, terms: list[tuple[int, int]]) -> np.ndarray:
        """Full scores of documents, from their own lists."""
        for t, f in terms:
            self.factors[t] = f
        out = [int((self.factors[self.doc_terms[a:b]] * self.doc_impacts[a:b]).sum()) for a, b in zip(self.doc_ends[docs], self.doc_ends[docs + 1], strict=True)]
        for t, _ in terms:
            self.factors[t] = 0
        return np.array(out, np.int64)

    @staticmethod
    def _top(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((docs, -scores))[:k]
        return docs[order], scores[order]


def _searching(items: list[tuple[int, list[tuple[str, int]]]], k: int):
    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                values = {name: batch.column(name)[r].values for name in _SHARD}
                shard = Shard({name: x.to_pylist() if name == "vocabulary" else x.to_numpy(zero_copy_only=False) for name, x in values.items()})
                found = [(item, *shard.best(asked, k)) for item, asked in items]
                columns = [np.repeat([x[0] for x in found], [len(x[1]) for x in found]), shard.docs[np.concatenate([x[1] for x in found])], np.concatenate([x[2] for x in found])]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["item", "doc", "score"])

    return search


def search(docs: DataFrame, items: DataFrame, k: int = BEST, shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item; docs has doc_id and text, items item_id and text."""
    by_batches(docs.sparkSession)
    asked = settled(item_terms(items), "item-terms")
    bits = bitmap(asked.select(_hash_place(F.col("term")).alias("place")), "place")
    counts = settled(term_counts(docs, bits), "term-counts")
    known = counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    total_docs, total_terms = int(known["docs"]), int(known["terms"])
    index = settled(impact_index(counts, total_docs, total_terms, shard_postings), "impact-index")

    df = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    factors = asked.join(df, F.col("term") == F.col("t")).select("item", "item_id", "term", (weight * F.col("times")).alias("factor")).where("factor > 0")
    factors = settled(factors, "item-factors")

    # Items go to all shards in blocks of a bounded number of terms, one after another.
    blocks = max(1, -(-factors.count() // block_terms))
    found = None
    for b in range(blocks):
        held: dict[int, list[tuple[str, int]]] = {}
        for row in factors.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "term", "factor").toArrow().to_pylist():
            held.setdefault(row["item"], []).append((row["term"], row["factor"]))
        if held or found is None:
            part = index if held else index.limit(0)
            part = settled(part.mapInArrow(_searching(sorted(held.items()), k), "item long, doc long, score long"), "found")
            found = part if found is None else found.unionByName(part)
    named = found.join(counts.select("doc", "doc_id"), "doc")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(factors.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranking(spark, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
known AS (SELECT count(*)::BIGINT AS total, sum(len(terms))::BIGINT AS words FROM docs WHERE len(terms) > 0),
post AS (SELECT doc, doc_id, term, count(*)::BIGINT AS tf, n FROM (SELECT doc, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs) GROUP BY doc, doc_id, term, n),
idf AS (SELECT term, CAST(floor(1000::DOUBLE * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term), known),
items AS (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, item, term, count(*)::BIGINT AS times FROM items GROUP BY item_id, item, term),
scored AS (
  SELECT item_id, item, doc_id, doc, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // words))))::BIGINT AS score
  FROM asked JOIN post USING (term) JOIN idf USING (term), known GROUP BY item_id, item, doc_id, doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
