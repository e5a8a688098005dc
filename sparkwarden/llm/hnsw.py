"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one node, which keeps as many of its smallest ids as a result can name; nodes are dealt to shards by hash,
so a frequent vector or a dense cluster fills no shard. A shard's graph is stored as flat arrays in one row of the index
table. Every query visits every shard: queries are streamed to the shard's task behind its index row, and the k best of each
shard are merged by rank. Scores are computed in double precision on the original vectors.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import staged

c = F.col
SHARD_ROWS, LINKS, WIDE, SEARCH = 4096, 16, 64, 128


class Graph:
    """Unit vectors, and per level an array of neighbours (-1: none) by node; a node is in the levels up to its own."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, neighbours: list[np.ndarray], entry: int):
        self.unit, self.levels, self.neighbours, self.entry = unit, levels, neighbours, entry

    def nearest(self, q: np.ndarray, start: list[tuple[float, int]], wide: int, level: int) -> list[tuple[float, int]]:
        """Best-first search on one level from (similarity, node) starts; the `wide` most similar, best first."""
        seen = np.zeros(len(self.unit), bool)
        seen[[n for _, n in start]] = True
        open_ = [(-s, n) for s, n in start]
        best = list(start)
        heapq.heapify(open_)
        heapq.heapify(best)
        links, unit = self.neighbours[level], self.unit
        while open_:
            s, node = heapq.heappop(open_)
            if len(best) >= wide and -s < best[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for x, n in zip((unit[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < wide:
                    heapq.heappush(best, (x, n))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, n))
                else:
                    continue
                heapq.heappush(open_, (-x, n))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, wide: int) -> list[int]:
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self.nearest(q, at, 1, level)[:1]
        return [n for _, n in self.nearest(q, at, wide, 0)]

    def spread(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours to keep, most similar first: each nearer to the node than to those kept before it; then the rest."""
        nodes = [n for _, n in candidates]
        among = self.unit[nodes] @ self.unit[nodes].T
        kept: list[int] = []
        left: list[int] = []
        for i, (s, _) in enumerate(candidates):
            if len(kept) == most:
                break
            (left if kept and among[i, kept].max() > s else kept).append(i)
        return [nodes[i] for i in (kept + left)[:most]]

    @classmethod
    def build(cls, unit: np.ndarray, links: int = LINKS, wide: int = WIDE, seed: int = 0) -> Graph:
        """Nodes are put in one after the other. Neighbour lists have twice their room and are thinned when that is full."""
        n, draw = len(unit), random.Random(seed)
        levels = np.array([int(-math.log(1 - draw.random()) / math.log(links)) for _ in range(n)], dtype=np.int32)
        room = lambda level: 2 * links if level == 0 else links
        top = int(levels.max())
        g = cls(unit, levels, [np.full((n, 2 * room(k)), -1, dtype=np.int32) for k in range(top + 1)], 0)
        used = [np.zeros(n, dtype=np.int32) for _ in range(top + 1)]
        for node in range(1, n):
            q = unit[node]
            at = [(float(unit[g.entry] @ q), g.entry)]
            for level in range(int(levels[g.entry]), -1, -1):
                if level > levels[node]:
                    at = g.nearest(q, at, 1, level)[:1]
                    continue
                at = g.nearest(q, at, wide, level)
                for other in (mine := g.spread(at, links)):
                    k = used[level][other]
                    g.neighbours[level][other, k] = node
                    used[level][other] = k + 1
                    if k + 1 == 2 * room(level):
                        near = g.neighbours[level][other]
                        thin = g.spread(sorted(zip((unit[near] @ unit[other]).tolist(), near.tolist(), strict=True), reverse=True), room(level))
                        g.neighbours[level][other] = -1
                        g.neighbours[level][other, : len(thin)] = thin
                        used[level][other] = len(thin)
                g.neighbours[level][node, : len(mine)] = mine
                used[level][node] = len(mine)
            if levels[node] > levels[g.entry]:
                g.entry = node
        return g


def unit_of(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scaled(v: np.ndarray) -> np.ndarray:
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def cosines(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, on the original vectors: scaled by powers of two, which changes no digit, so that squares stay in range."""
    v, w = scaled(vectors.astype(np.float64)), scaled(q.astype(np.float64)[None])[0]
    return v @ w / (np.linalg.norm(v, axis=1) * np.linalg.norm(w))


INDEX = "shard int, dim int, vectors binary, ids binary, id_ends binary, levels binary, neighbours array<binary>, entry int"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, dim); a shard has about SHARD_ROWS rows."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b[k].to_pylist() for k in ("shard", "dim", "vec_ids", "embedding")), strict=True)

    for (shard, dim), group in groupby(rows(), key=lambda r: r[:2]):
        got = list(group)
        vectors = np.array([r[3] for r in got], dtype=np.float64)
        g = Graph.build(unit_of(vectors))
        yield pa.RecordBatch.from_pylist([{
            "shard": shard, "dim": dim, "vectors": vectors.tobytes(), "ids": np.array([i for r in got for i in r[2]], np.int64).tobytes(),
            "id_ends": np.cumsum([len(r[2]) for r in got]).astype(np.int64).tobytes(), "levels": g.levels.tobytes(),
            "neighbours": [x.tobytes() for x in g.neighbours], "entry": g.entry,
        }], pa.schema([("shard", pa.int32()), ("dim", pa.int32()), *[(k, pa.binary()) for k in ("vectors", "ids", "id_ends", "levels")],
                       ("neighbours", pa.list_(pa.binary())), ("entry", pa.int32())]))


def _searched(k: int, wide: int):
    """Rows come sorted by (shard, dim), the index row before its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, g, vectors, ids, ends = None, None, None, None, None
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in b.to_pylist():
                if row["query_id"] is None:
                    of = (row["shard"], row["dim"])
                    n = len(row["levels"]) // 4
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
                    ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)
                    g = Graph(unit_of(vectors), np.frombuffer(row["levels"], np.int32),
                              [np.frombuffer(x, np.int32).reshape(n, -1) for x in row["neighbours"]], row["entry"])
                elif of == (row["shard"], row["dim"]):
                    q = np.array(row["embedding"], dtype=np.float64)
                    nodes = np.array(g.search(unit_of(q[None])[0], wide))
                    scores = cosines(vectors[nodes], q)
                    found = [(-s, i) for s, n in zip(scores.tolist(), nodes.tolist(), strict=True)
                             for i in ids[ends[n - 1] if n else 0 : ends[n]].tolist() if i != row["query_id"]]
                    for s, i in heapq.nsmallest(k, found):
                        out[0].append(row["query_id"])
                        out[1].append(i)
                        out[2].append(-s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                                             ["query_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), dim of the rows that can be compared: an id, and a vector of finite numbers, not all zero."""
    v = rows.select("vec_id", c("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return v.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index table over all usable rows, and its number of shards. A node keeps k + 1 ids, so that a query's own can be left out."""
    ranked = usable(rows).distinct().withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(c("n") <= k + 1)
    nodes = staged(ranked.groupBy("embedding", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    return staged(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "vec_ids").mapInArrow(_built, INDEX), "index"), shards


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, wide: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` the k nearest found among `rows` (both vec_id, embedding).

    Largest cosine first, ties to the smaller vec_id; the query's own vec_id is no candidate. Fewer than k candidates give as
    many rows. Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows
    without a vec_id; vectors of another length than the query's are not compared with it. Repeated rows count once. Empty
    tables give no rows. Other columns are not read. A frequent vector is one node with the ids that a result can name.
    """
    table, shards = index(rows, k, shard_rows)
    asked = (usable(queries).distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
             .select("shard", "dim", c("vec_id").alias("query_id"), "embedding"))
    both = table.unionByName(asked, allowMissingColumns=True)
    found = both.repartition(shards, "shard").sortWithinPartitions("shard", "dim", c("query_id").asc_nulls_first()).mapInArrow(
        _searched(k, wide), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")
