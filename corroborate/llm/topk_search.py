"""Exact top-k by inner product with one KD-tree per shard.

Vectors are dealt to shards by a hash of their id.  Each shard becomes a KD-tree:
the widest dimension is split at its median until leaves are small, and every node
keeps the tight bounding box of its members.  The largest inner product a box can
reach with a query bounds all its members, so a best-first walk opens the most
promising box first and ends when the best open bound falls below the k-th score.

Queries are a stated set, packed in blocks of ``query_rows``; every block meets every
shard, in groups of one shard and up to ``BLOCKS`` blocks, so all of it is one job of
Spark.  A first pass over a bounded pilot shard gives each query a k-th score that the
second pass starts from, so the other shards prune from the outset.  A bound equal to
the k-th score is still opened, which keeps ties exact.  Shard results are k rows per
query, merged by a group on the query.

Components are floor(256 * x) with x in double precision, held to the range of a long.
Scores are exact integers: in doubles where they stay below 2**53 (components up to
2**20 in 64 dimensions), else in whole numbers without the tree; beyond a long they
read its limit.

Defined results: vectors that are null, empty or hold a null or non-finite component
take no part, nor do rows without an id; vectors of another length than the query's
are no candidates for it; ties go to the smaller vec_id; repeated rows are separate
candidates, but a query's own id never is one; rows repeating a query give its result
once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

K, QUERY_EVERY, LEAF, SHARD_ROWS, QUERY_ROWS, PILOT_ROWS, BLOCKS = 5, 50, 128, 16_384, 4096, 4096, 8
EXACT, LONG = 2.0**53, (1 << 63) - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v = floor(256 * x) of each usable vector."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.where(F.coalesce(usable, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 256).cast("double")).alias("v"))


class KdTree:
    """Boxes and members of one shard's vectors of one length."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.nodes: list[tuple] = []  # low, high, members or None, left, right
        self._split(np.arange(len(ids)), leaf)
        self.low = np.array([n[0] for n in self.nodes])
        self.high = np.array([n[1] for n in self.nodes])

    def _split(self, members: np.ndarray, leaf: int) -> int:
        own = self.points[members]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, members, -1, -1))
        if len(members) > leaf and (high > low).any():
            axis = int((high - low).argmax())
            half = len(members) // 2
            part = np.argpartition(own[:, axis], half)
            left, right = self._split(members[part[:half]], leaf), self._split(members[part[half:]], leaf)
            self.nodes[at] = (low, high, None, left, right)
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own_id: int, k: int, floor: float, bound: np.ndarray) -> list[tuple[float, int]]:
        """The k best (score, -id), none below ``floor``."""
        best: list[tuple[float, int]] = []
        queue = [(-bound[0], 0)]
        while queue:
            top, node = heapq.heappop(queue)
            if -top < (max(floor, best[0][0]) if len(best) == k else floor):
                break
            _, _, members, left, right = self.nodes[node]
            if members is None:
                heapq.heappush(queue, (-bound[left], left))
                heapq.heappush(queue, (-bound[right], right))
                continue
            score = self.points[members] @ query
            limit = max(floor, best[0][0]) if len(best) == k else floor
            for j in np.flatnonzero(score >= limit):
                i = int(self.ids[members[j]])
                if i == own_id:
                    continue
                item = (float(score[j]), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _pack(key, table):
    """The vectors of a group, one row per length."""
    ids, vectors = np.asarray(table.column("vec_id")).astype(np.int64), table.column("v").combine_chunks()
    floors = np.asarray(table.column("floor")).astype(float)
    sizes = np.asarray(vectors.value_lengths())
    begin, flat = np.cumsum(sizes) - sizes, np.asarray(vectors.flatten())
    rows: dict[str, list] = {"dim": [], "ids": [], "points": [], "floors": []}
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        rows["dim"].append(int(dim))
        rows["ids"].append(ids[own].tobytes())
        rows["points"].append(flat[begin[own][:, None] + np.arange(dim)].tobytes())
        rows["floors"].append(floors[own].tobytes())
    kinds = {"dim": pa.int32(), "ids": pa.binary(), "points": pa.binary(), "floors": pa.binary()}
    return pa.table({"g": pa.array([key[0].as_py()] * len(rows["dim"]), pa.int32())} | {n: pa.array(rows[n], t) for n, t in kinds.items()})


_PACKED = "g int, dim int, ids binary, points binary, floors binary"


def packed(vectors: DataFrame, group) -> DataFrame:
    """One row per group and length of vectors (vec_id, v, floor)."""
    return vectors.withColumn("g", group.cast("int")).groupBy("g").applyInArrow(_pack, _PACKED)


def _unpacked(dim: int, ids, points, floors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(points.as_buffer(), np.float64).reshape(-1, dim), np.frombuffer(floors.as_buffer(), np.float64)


def _whole(points: np.ndarray) -> np.ndarray:
    """As Python integers, a saturated component as the limit of a long."""
    return np.array([[max(-LONG - 1, min(LONG, int(x))) for x in p] for p in points], object).reshape(points.shape)


def _top_exact(ids: np.ndarray, points: np.ndarray, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
    score = points @ query
    return heapq.nlargest(k, ((max(-LONG - 1, min(LONG, int(s))), -int(i)) for s, i in zip(score, ids, strict=True) if i != own_id))


def _search(k: int):
    """Top k of each query of some blocks within one shard."""

    def run(key, left, right):
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for row in range(left.num_rows):
            dim = left["dim"][row].as_py()
            ids, points, _ = _unpacked(dim, *(left[n][row] for n in ("ids", "points", "floors")))
            tree, whole = KdTree(ids, points), None
            for b in range(right.num_rows):
                if right["dim"][b].as_py() != dim:
                    continue
                query_ids, queries, floors = _unpacked(dim, *(right[n][b] for n in ("ids", "points", "floors")))
                large = dim * np.abs(points).max() * np.abs(queries).max(axis=1) >= EXACT
                for at in range(0, len(query_ids), 512):
                    bound = tree.bounds(queries[at : at + 512])
                    for j in range(at, at + len(bound)):
                        q = int(query_ids[j])
                        if large[j]:
                            whole = _whole(points) if whole is None else whole
                            found = _top_exact(ids, whole, _whole(queries[j : j + 1])[0], q, k)
                        else:
                            found = tree.search(queries[j], q, k, floors[j], bound[j - at])
                        for score, neg in found:
                            out["query_id"].append(q)
                            out["vec_id"].append(-neg)
                            out["score"].append(int(score))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


_FOUND = "query_id long, vec_id long, score long"


def _meet(shards: DataFrame, n_shards: int, blocks: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """What every block finds in every shard: both are sent to groups of a shard and ``BLOCKS`` blocks."""
    parts = math.ceil(n_blocks / BLOCKS)
    a = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).withColumnRenamed("g", "shard")
    b = blocks.select("*", F.floor(F.col("g") / BLOCKS).cast("int").alias("block_part"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("block_shard"))
    tasks = n_shards * parts
    a, b = a.repartition(tasks, "shard", "part"), b.repartition(tasks, "block_shard", "block_part")
    return a.groupBy("shard", "part").cogroup(b.groupBy("block_shard", "block_part")).applyInArrow(_search(k), _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (both with vec_id and v)."""
    spark = vectors.sparkSession
    none = F.lit(float("-inf"))
    vectors = C.cut(vectors.select("vec_id", "v"))
    queries = C.cut(queries.select("vec_id", "v").groupBy("vec_id").agg(F.min("v").alias("v")))
    total, asked = vectors.count(), queries.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, math.ceil(total / shard_rows), min(tasks, total // 2048))
    blocks = max(1, math.ceil(asked / query_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    pilot = vectors.where(F.pmod(F.xxhash64("v", "vec_id"), F.lit(max(1, total // PILOT_ROWS))) == 0).withColumn("floor", none)
    first = _meet(packed(pilot, F.lit(0)), 1, packed(queries.withColumn("floor", none), block), blocks, k)
    floors = first.groupBy("query_id").agg(F.min("score").cast("double").alias("_floor"), F.count("*").alias("_n")).where(F.col("_n") >= k)
    started = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("_floor", none).alias("floor"))
    found = _meet(packed(vectors.withColumn("floor", none), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))), shards, packed(started, block), blocks, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
