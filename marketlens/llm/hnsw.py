"""Approximate nearest neighbours by largest inner product: one navigable small-world graph per shard.

Equal vectors are one class, so thousands of copies are one node. Classes are dealt to shards of bounded size by a hash;
each shard is built by one task as a hierarchy of layers, and stored as one row of flat arrays: vectors, and for each
layer its nodes and their neighbours (width M, or 2M in the bottom layer, padded by -1). Inner products become
neighbourhood on a sphere: one more component makes all vectors as long as the longest. Shards grow with the table up to
SHARD_BYTES of memory, then their number grows. Queries, in blocks, visit every shard; pairs of block and shard are dealt
over many tasks; a shard's beam search gives its nearest classes, and the shards' results are merged by exact double-precision
products. Insertion goes in batches that double with the graph; a batch sees the graph before it and itself.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another
length are compared with their like only; rows that repeat an id or a vector are candidates each, ties go to the smaller
id; a null vec_id is a candidate (last in ties) but no query; with fewer candidates than asked, all are returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, settled

#: Neighbours asked for; neighbours of a node in upper layers (twice that below); beam widths; nodes expanded at once.
NEAREST, M, EF_BUILD, EF_SEARCH, EXPAND = 20, 16, 64, 96, 4
#: Classes of a shard at least, shards up to which shards grow, memory of a shard at most, and queries of a block.
SHARD_ROWS, FEW_SHARDS, SHARD_BYTES, BLOCK = 8192, 64, 256 << 20, 512
#: Tasks that the pairs of shards and blocks should make at least.
SEARCH_TASKS = 64
SEED = 17


def beam(q: np.ndarray, vectors: np.ndarray, graph: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ef nodes of a layer for each row of q, from entry (rows, k): ids (-1: none) and products, best first."""
    rows = np.arange(len(q))[:, None]
    ids = np.full((len(q), ef), -1, np.int64)
    sims = np.full((len(q), ef), -np.inf, np.float32)
    done = np.ones((len(q), ef), bool)
    visited = np.zeros((len(q), len(vectors)), bool)
    new = entry
    while True:
        rank = np.sort(new, axis=1)
        fresh = (rank >= 0) & np.c_[np.ones(len(q), bool), rank[:, 1:] != rank[:, :-1]] & ~visited[rows, np.maximum(rank, 0)]
        if fresh.any():
            at = np.where(fresh, rank, 0)
            near = np.where(fresh, np.einsum("bd,bkd->bk", q, vectors[at]), -np.inf).astype(np.float32)
            visited[np.broadcast_to(rows, rank.shape)[fresh], rank[fresh]] = True
            all_ids, all_sims = np.c_[ids, np.where(fresh, rank, -1)], np.c_[sims, near]
            all_done = np.c_[done, ~fresh]
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids, sims, done = all_ids[rows, best], all_sims[rows, best], all_done[rows, best]
        if done.all():
            return ids, sims
        pick = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]  # the best that are not expanded
        open_ = ~done[rows, pick]
        done[rows, pick] = True
        new = np.where(open_[:, :, None], graph[np.maximum(ids[rows, pick], 0)], -1).reshape(len(q), -1)


def diverse(q: np.ndarray, vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of candidates, best first, those nearer to q than to any chosen before, filled up with the rest, to width."""
    own = vectors[np.maximum(ids, 0)]
    chosen = np.zeros(ids.shape, bool)
    nearest = np.full(ids.shape, -np.inf, np.float32)  # product with the nearest chosen candidate
    for k in range(ids.shape[1]):
        take = (ids[:, k] >= 0) & (sims[:, k] > nearest[:, k]) & (chosen.sum(axis=1) < width)
        chosen[:, k] = take
        if take.any():
            to = np.einsum("bd,bkd->bk", own[take, k], own[take])
            nearest[take] = np.maximum(nearest[take], to)
    order = np.argsort(np.where(ids < 0, 2, ~chosen), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, axis=1)
    return out if out.shape[1] == width else np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def layer(vectors: np.ndarray, width: int, entry) -> np.ndarray:
    """Neighbours (n, width) of one layer; entry(rows of vectors) gives their start nodes among those inserted before."""
    n = len(vectors)
    graph = np.full((n, width), -1, np.int64)
    first = 0
    while first < n:
        size = min(n - first, max(64, min(BLOCK, first)))
        batch = np.arange(first, first + size)
        q = vectors[batch]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(EF_BUILD, size)
        best = np.argsort(-own, axis=1)[:, :k]
        ids, sims = np.where(best == np.arange(size)[:, None], -1, best + first), np.take_along_axis(own, best, axis=1)
        if first:
            start = entry(batch)
            start = np.where(start < first, start, -1)
            start = np.c_[start, np.random.default_rng(first).integers(0, first, (size, 4))]
            old, old_sims = beam(q, vectors, graph, start, EF_BUILD)
            ids, sims = np.c_[ids, old], np.c_[sims, old_sims]
            order = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        graph[batch] = diverse(q, vectors, ids, sims, width)
        # Links back: targets get the batch's nodes, and choose anew among old and new neighbours.
        back = np.repeat(batch, width), graph[batch].ravel()
        source, target = back[0][back[1] >= 0], back[1][back[1] >= 0]
        order = np.lexsort((-np.einsum("bd,bd->b", vectors[source], vectors[target]), target))
        source, target = source[order], target[order]
        nodes, begin, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begin, counts)
        for a in range(0, len(nodes), 2 * BLOCK):
            part = nodes[a : a + 2 * BLOCK]
            inside = (target >= part[0]) & (target <= part[-1]) & (place < 2 * width)
            more = np.full((len(part), 2 * width), -1, np.int64)
            more[np.searchsorted(part, target[inside]), place[inside]] = source[inside]
            both = np.c_[graph[part], more]
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            near = np.where(both >= 0, np.einsum("bd,bkd->bk", vectors[part], vectors[np.maximum(both, 0)]), -np.inf)
            rank = np.argsort(-near, axis=1, kind="stable")
            graph[part] = diverse(vectors[part], vectors, np.take_along_axis(both, rank, axis=1), np.take_along_axis(near, rank, axis=1).astype(np.float32), width)
        first += size
    return graph


class Graph:
    """A shard: vectors (double), node ids, and layers as (positions of the layer's nodes, neighbours among them)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.vectors, self.layers = ids, vectors, layers
        self.near = vectors.astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, longest: float) -> Graph:
        rank = np.random.default_rng(SEED).permutation(len(ids))
        ids, vectors = ids[rank], vectors[rank]
        lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        round_ = np.c_[vectors, lift].astype(np.float32)
        # Random levels: after the shuffle, the first n / M**l nodes are those of layer l.
        sizes = [len(ids)]
        while sizes[-1] > 4 * M:
            sizes.append(-(-sizes[-1] // M))
        graph = cls(ids, vectors, [])
        for size in reversed(sizes):
            entry = lambda batch, round_=round_: graph._entry(round_[batch], round_)
            graph.layers.insert(0, (np.arange(size), layer(round_[:size], 2 * M if size == sizes[0] else M, entry)))
        return graph

    def _entry(self, q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Start nodes for the layer below the lowest of self.layers."""
        at = np.zeros((len(q), 1), np.int64)
        for nodes, graph in reversed(self.layers):
            at, _ = beam(q, vectors[: len(nodes)], graph, at, 4)
        return at

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Node ids (-1: none) and exact products of the k nearest found for each row of q, best first."""
        flat = q.astype(np.float32)
        at = np.zeros((len(q), 1), np.int64)
        for nodes, graph in reversed(self.layers[1:]):
            at, _ = beam(flat, self.near[: len(nodes)], graph, at, 8)
        found, _ = beam(flat, self.near, self.layers[0][1], at, max(EF_SEARCH, k))
        exact = np.where(found >= 0, np.einsum("bd,bkd->bk", q, self.vectors[np.maximum(found, 0)]), -np.inf)
        order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        found, exact = np.take_along_axis(found, order, axis=1), np.take_along_axis(exact, order, axis=1)
        return np.where(found >= 0, self.ids[np.maximum(found, 0)], -1), exact

    def row(self) -> dict:
        """The shard as flat arrays."""
        return {
            "ids": self.ids.tobytes(),
            "vectors": self.vectors.tobytes(),
            "sizes": [len(nodes) for nodes, _ in self.layers],
            "neighbours": [graph.astype(np.int32).tobytes() for _, graph in self.layers],
        }

    @classmethod
    def of(cls, row) -> Graph:
        ids = np.frombuffer(row["ids"], np.int64)
        layers = [(np.arange(n), np.frombuffer(x, np.int32).reshape(n, -1).astype(np.int64)) for n, x in zip(row["sizes"], row["neighbours"], strict=True)]
        return cls(ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1), layers)


INDEX = "dim int, shard int, ids binary, vectors binary, sizes array<int>, neighbours array<binary>"


def index(classes: DataFrame, longest: float) -> DataFrame:
    """The index of classes (node, vec, dim, shard): one row per shard, written to the shared folder."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        graph = Graph.build(pdf["node"].to_numpy(np.int64), np.array(pdf["vec"].tolist(), np.float64), longest)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], **graph.row()}])

    return settled(classes.select("node", "vec", "dim", "shard").groupBy("dim", "shard").applyInPandas(build, INDEX), "graphs")


def found_in(graphs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, node, score): the k nearest nodes of each shard for queries (query, vec, dim), in blocks against all shards."""
    spark = queries.sparkSession
    n = max(1, -(-queries.count() // BLOCK))
    blocks = queries.groupBy("dim", F.pmod(F.xxhash64("query"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("query", "vec")).alias("own"))

    def search(frames):
        last, graph = None, None
        for pdf in frames:
            for row in pdf.to_dict("records"):
                if (row["dim"], row["shard"]) != last:
                    last, graph = (row["dim"], row["shard"]), Graph.of(row)
                ids = np.array([x["query"] for x in row["own"]], np.int64)
                found, exact = graph.search(np.array([x["vec"] for x in row["own"]], np.float64), k)
                some = found >= 0
                yield pd.DataFrame({"query": np.repeat(ids, some.sum(axis=1)), "node": found[some], "score": exact[some]})

    # A block meets each shard once; shards are copied to as many salts as make enough tasks.
    shards = graphs.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    most = graphs.count()
    salts = max(1, min(n, -(-SEARCH_TASKS // max(1, most))))
    pairs = blocks.join(F.broadcast(shards), "dim").select("dim", "own", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    copies = graphs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = pairs.join(copies.hint("merge"), ["dim", "shard", "salt"])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")  # a row holds a shard and a block of queries
    try:
        return settled(met.mapInPandas(search, "query long, node long, score double"), "found")
    finally:
        spark.conf.set(key, before)


def shard_size(rows: int, dim: int) -> int:
    """Classes of a shard: FEW_SHARDS shards or fewer as long as a shard fits its memory (vectors, their copies, neighbours)."""
    fits = max(1, SHARD_BYTES // (3 * 8 * max(1, dim) + 3 * 8 * M))
    return min(fits, max(SHARD_ROWS, -(-rows // FEW_SHARDS)))


def neighbours(vectors: DataFrame, is_query, k: int = NEAREST, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) where is_query holds."""
    vec = F.col("embedding").cast("array<double>")
    fit = F.col("embedding").isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(fit).select("vec_id", F.transform(vec, lambda x: x + F.lit(0.0)).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.groupBy("vec").agg(F.min("row").alias("node"), F.max("asks").alias("asks"), F.min("vec_id").alias("low"))
    classes = settled(classes.withColumn("dim", F.size("vec")), "vector-classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.max("dim").alias("dim")).first()
    shard_rows = shard_rows or shard_size(size["n"], size["dim"] or 1)
    shards = max(1, -(-size["n"] // shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    graphs = index(dealt, float(size["most"] or 0.0) ** 0.5)
    found = found_in(graphs, classes.where("asks").select(F.col("node").alias("query"), "vec", "dim"), k + 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("low").asc_nulls_last())
    merged = found.join(classes.select("node", "low"), "node").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("query", "node", "score")
    # A class's first k + 1 members are all that any query can return of it.
    of_class = rows.join(classes.select("vec", "node"), "vec").select("node", "row", "vec_id", "asks")
    first = Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    members = of_class.withColumn("m", F.row_number().over(first)).where(F.col("m") <= k + 1).select("node", "row", "vec_id")
    options = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    listed = merged.join(members, "node").withColumn("m", F.row_number().over(options)).where(F.col("m") <= k + 1).select("query", "row", "vec_id", "score")
    asked = of_class.where("asks").select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    final = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    out = asked.join(listed, "query").where("row <> own").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op3_hnsw(spark, sf_dir: str) -> DataFrame:
    return neighbours(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
