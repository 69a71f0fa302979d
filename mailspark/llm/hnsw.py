"""Nearest neighbours by cosine: one small-world graph per shard, merged.

Equal vectors become one node that carries its smallest ids (as many as a
result can name). Nodes are dealt over shards by hash; each shard's task builds
a hierarchical graph and stores it as flat neighbour arrays in the shared
folder. Blocks of queries then meet every shard. All that a graph's search
keeps is scored by the exact cosine of the original vectors in double
precision; each shard's best by score and id are ranked together.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, as query or candidate; nor do rows without an id.
Only vectors of equal length are compared. Repeated rows count once. With
fewer than ``k`` candidates all are returned; an empty table gives an empty
table; other columns do not enter.
"""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

SHARD_ROWS = 4096    # nodes of one graph, about
BLOCK_QUERIES = 512  # queries that meet one graph in one go
LINKS = 16           # neighbours of a node above the ground level; twice as many on it
EF_BUILD = 96
EF_SEARCH = 160
SAME = 4 * np.finfo(np.float32).eps   # directions this near are one to single precision


class Graph:
    """Hierarchical navigable small world over unit vectors.

    A vector whose direction single precision cannot tell from one in the graph
    is not linked (links among such would leave some out of reach) but chained
    to that one: ``twins`` holds the next of each chain.
    """

    def __init__(self, unit: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int, twins: np.ndarray):
        self.unit, self.levels, self.links, self.entry, self.twins = unit, levels, links, entry, twins
        self.seen = np.zeros(len(unit), np.int64)
        self.stamp = 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> "Graph":
        unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        n = len(unit)
        levels = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(LINKS)).astype(int)
        links = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, np.int32) for level in range(levels.max() + 1)]
        graph = cls(unit, levels, links, 0, np.full(n, -1, np.int32))
        for node in range(1, n):
            graph._insert(node)
        return graph

    def _layer(self, q: np.ndarray, entries: list[int], level: int, ef: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest found on a level, nearest first."""
        self.stamp += 1
        seen, stamp, unit, links = self.seen, self.stamp, self.unit, self.links[level]
        best, todo = [], []
        for e, s in zip(entries, (unit[entries] @ q).tolist()):
            seen[e] = stamp
            best.append((s, e))
            todo.append((-s, e))
        heapq.heapify(best)
        heapq.heapify(todo)
        while todo:
            s, node = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= ef:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            sims = unit[near] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for s, e in zip(sims.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (s, e))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, e))
                else:
                    continue
                heapq.heappush(todo, (-s, e))
        return sorted(best, reverse=True)

    def _choose(self, nodes: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` of ``nodes`` (nearest first), none nearer to one chosen
        before than to the centre; then the nearest of the rest."""
        if len(nodes) <= m:
            return nodes
        between = self.unit[nodes] @ self.unit[nodes].T
        blocked = np.zeros(len(nodes), bool)
        chosen = []
        for i in range(len(nodes)):
            if not blocked[i]:
                chosen.append(i)
                if len(chosen) == m:
                    break
                blocked |= between[i] > sims
        if len(chosen) < m:
            rest = np.setdiff1d(np.arange(len(nodes)), chosen)
            chosen += rest[:m - len(chosen)].tolist()
        return nodes[chosen]

    def _insert(self, node: int) -> None:
        q, top = self.unit[node], self.levels[self.entry]
        entries = [self.entry]
        for level in range(top, self.levels[node], -1):
            entries = [self._layer(q, entries, level, 1)[0][1]]
        around = []
        for level in range(min(top, self.levels[node]), -1, -1):
            found = self._layer(q, entries, level, EF_BUILD)
            around.append((level, found))
            entries = [e for _, e in found]
        if found[0][0] >= 1 - SAME:
            self.twins[node], self.twins[entries[0]] = self.twins[entries[0]], node
            return
        for level, found in around:
            links, m = self.links[level], self.links[level].shape[1]
            picked = self._choose(np.array([e for _, e in found]), np.array([s for s, _ in found]), LINKS)
            links[node, :len(picked)] = picked
            for other in picked.tolist():
                row = links[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    both = np.append(row, node)
                    sims = self.unit[both] @ self.unit[other]
                    o = np.argsort(-sims)
                    kept = self._choose(both[o], sims[o], m)
                    row[:] = -1
                    row[:len(kept)] = kept
        if self.levels[node] > top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        """The ``ef`` nearest found with their twins, for an exact score to rank.
        Where single precision cannot tell the last of them from the ``k``-th,
        the search widens until it can or nothing more is found."""
        entries = [self.entry]
        for level in range(self.levels[self.entry], 0, -1):
            entries = [self._layer(q, entries, level, 1)[0][1]]
        doubt, ef = SAME * np.sqrt(len(q)), max(ef, k)
        while True:
            found = self._layer(q, entries, 0, ef)
            if len(found) < ef or found[-1][0] < found[k - 1][0] - doubt:
                break
            ef *= 2
        nodes = []
        for _, e in found:
            while e >= 0:
                nodes.append(e)
                e = int(self.twins[e])
        return nodes


_GRAPH = ("dim int, shard int, n int, entry int, levels array<int>, links array<binary>, twins binary, vectors binary, "
          "ids array<array<bigint>>")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard: its graph as flat arrays."""
    def graph_of(key, ids, vectors):
        x = np.stack(vectors)
        g = Graph.build(x.astype(np.float64))
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([key[0]], pa.int32()), "shard": pa.array([key[1]], pa.int32()),
            "n": pa.array([len(ids)], pa.int32()), "entry": pa.array([g.entry], pa.int32()),
            "levels": pa.array([g.levels.tolist()], pa.list_(pa.int32())),
            "links": pa.array([[x.tobytes() for x in g.links]], pa.list_(pa.binary())),
            "twins": pa.array([g.twins.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()),
            "ids": pa.array([ids], pa.list_(pa.list_(pa.int64())))})

    key, ids, vectors = None, [], []
    for batch in batches:
        for dim, shard, own, v in zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "ids", "v"))):
            if (dim, shard) != key and ids:
                yield graph_of(key, ids, vectors)
                ids, vectors = [], []
            key = dim, shard
            ids.append(own)
            vectors.append(np.array(v, np.float64))
    if ids:
        yield graph_of(key, ids, vectors)


def _search(k: int, ef: int):
    def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = vectors = ids = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["role"] == 0:
                    g = row["graph"]
                    vectors = np.frombuffer(g["vectors"], np.float64).reshape(g["n"], -1)
                    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
                    links = [np.frombuffer(x, np.int32).reshape(g["n"], -1) for x in g["links"]]
                    graph = Graph(unit, np.array(g["levels"]), links, g["entry"], np.frombuffer(g["twins"], np.int32))
                    ids = g["ids"]
                    continue
                out = {"query_id": [], "vec_id": [], "score": []}
                for query in row["queries"]:
                    q = np.array(query["v"], np.float64)
                    found = graph.search((q / np.linalg.norm(q)).astype(np.float32), k + 1, ef)
                    scored = ((-score, other) for node, score in zip(found, cosine(vectors[found], q).tolist())
                              for other in ids[node] if other != query["id"])
                    for score, other in heapq.nsmallest(k, scored):
                        out["query_id"].append(query["id"])
                        out["vec_id"].append(other)
                        out["score"].append(-score)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                    "score": pa.array(out["score"], pa.float64())})
    return run


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v`` (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = ("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
            "AND exists(v, x -> x <> 0)")
    return rows.filter(F.expr(fine)).distinct()


def build_graphs(rows: DataFrame, k: int) -> DataFrame:
    """The stored graphs of ``id, v``, one row per shard."""
    order = Window.partitionBy("v").orderBy("id")
    nodes = stage(rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
                  .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                  .select("v", "ids", F.size("v").alias("dim")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    return stage(dealt.select("dim", "shard", "ids", "v").repartition(shards, "dim", "shard")
                 .sortWithinPartitions("dim", "shard", F.col("ids")[0]).mapInArrow(_build, _GRAPH), "graphs")


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``table``
    found for each row of ``queries`` (both ``key, vector``), itself excepted;
    ties to the smaller id."""
    graphs = build_graphs(usable(table, key, vector), k)
    asked = usable(queries, key, vector).withColumn("dim", F.size("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    packed = stage(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
                   .groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries")), "queries")
    # every graph meets every block: one row of each per cell
    shards = graphs.select("dim", "shard")
    graph = F.struct("n", "entry", "levels", "links", "twins", "vectors", "ids").alias("graph")
    left = (graphs.join(packed.select(F.col("dim").alias("q_dim"), "block"), F.col("dim") == F.col("q_dim"))
            .select("dim", "shard", "block", F.lit(0).alias("role"), graph, F.lit(None).alias("queries")))
    right = (packed.join(shards, "dim").select("dim", "shard", "block", F.lit(1).alias("role"),
                                               F.lit(None).alias("graph"), "queries"))
    cells = left.unionByName(right).repartition("dim", "shard", "block").sortWithinPartitions(
        "dim", "shard", "block", "role")
    found = cells.mapInArrow(_search(k, ef), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose id is divisible by 50."""
    table = embeddings.select("vec_id", "embedding")
    return nearest(table, table.filter("vec_id % 50 = 0"))
