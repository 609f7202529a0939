"""Exact top-k search by inner product with one KD-tree per shard.

Candidates are dealt over shards of a bounded size, a task for each; queries stream past the shard's tree in batches, so
it is built once in a step. Each shard's tree splits at medians of the widest dimension and
keeps the tight bounding box of every node. A query visits nodes best-first: the largest inner product any point of a
box can have with the query bounds the node's scores, and the search of a shard ends when that bound falls below the
kth score. That kth score is carried over: a first step searches each query's home shard alone, and the other shards
start with its kth score as their bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD = 20_000
LEAF = 64


class KDTree:
    """points: integers as float64 (exact below 2**53) or Python integers where products could exceed that."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids, self.leaf = points, ids, leaf
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.node: list[tuple[int, int] | np.ndarray] = []  # children, or the rows of a leaf
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        at, part = len(self.node), self.points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.node.append(rows)
        if len(rows) > self.leaf and len(low) and high[wide := int(np.argmax(high - low))] > low[wide]:
            order = np.argsort(part[:, wide], kind="stable")
            half = len(rows) // 2
            self.node[at] = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query's position, id, score) of up to k best points per query that score at least the query's bound."""
        if not self.node or not len(queries):
            return
        reach = np.maximum(queries, 0) @ np.array(self.high).T + np.minimum(queries, 0) @ np.array(self.low).T
        for i, q in enumerate(queries):
            limit, own, mine = bounds[i], reach[i], query_ids[i]
            best: list[tuple[int, int]] = []  # (score, -id)
            queue = [(-own[0], 0)]
            while queue:
                bound, at = heapq.heappop(queue)
                if -bound < limit:
                    break
                node = self.node[at]
                if isinstance(node, tuple):
                    for child in node:
                        if own[child] >= limit:
                            heapq.heappush(queue, (-own[child], child))
                    continue
                scores = self.points[node] @ q
                for j in np.flatnonzero(scores >= limit):
                    row = node[j]
                    if self.ids[row] == mine:
                        continue
                    item = (int(scores[j]), -int(self.ids[row]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        limit = max(limit, best[0][0])
            for score, minus_id in best:
                yield i, -minus_id, score


LEAST = -(1 << 63)


def answers(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (shard, dim, asks, id, v, bound), in which the queries of a shard come after its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (ids, vectors) of the shard's candidates
        now, trees = None, {}
        for batch in batches:
            shard, dim, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1]), True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if now != (shard[a], dim[a]):
                    now, held, trees = (shard[a], dim[a]), [], {}
                vectors = batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(dim[a]))
                if not asks[a]:
                    held.append((ids[a:b], vectors))
                    continue
                if not held:
                    continue
                most = max(int(np.abs(x).max(initial=0)) for _, x in held) * int(np.abs(vectors).max(initial=0)) * max(1, int(dim[a]))
                kind = np.float64 if most < 1 << 53 else object  # exact either way
                if kind not in trees:
                    trees[kind] = KDTree(np.concatenate([x for _, x in held]).astype(kind), np.concatenate([i for i, _ in held]))
                bounds = np.array([LEAST if x is None else x for x in batch.column(5).slice(a, b - a).to_pylist()], dtype=kind)
                found = [(int(ids[a + i]), other, max(LEAST, min(-LEAST - 1, score))) for i, other, score in trees[kind].search(vectors.astype(kind), ids[a:b], bounds, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of vectors whose components are all there and finite."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")).alias("v")
    )


def exact_top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own id. Vectors that
    are null or hold null or non-finite components, and rows without an id, take no part; vectors of different
    lengths do not meet. Scores beyond a long are held at its limits. Repeated rows are candidates each. Fewer candidates give fewer rows, an empty table none.
    """
    data = materialize(quantized(vectors, scale, id_col, vector_col).withColumn("dim", F.size("v")), "topk-vectors")
    n = data.count()
    shards = max(1, -(-n // shard_rows))
    rows = data.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "bound": F.lit(None).cast("long")})
    queries = rows.filter(F.col("id") % every == 0)

    def searched(asked: DataFrame) -> DataFrame:
        """The answers to (id, v, dim, shard, bound) from the candidates of the same shard and length of vectors."""
        both = rows.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
        return both.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "asks").select("shard", "dim", "asks", "id", "v", "bound").mapInArrow(answers(k), "query_id long, vec_id long, score long")

    first = materialize(searched(queries), "topk-home")
    kth = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("found")).select(F.col("query_id").alias("id"), F.when(F.col("found") >= k, F.col("low")).alias("bound"))
    found = first
    if shards > 1:
        asked = queries.drop("bound").join(kth, "id", "left")
        asked = asked.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("other <> shard").withColumn("shard", F.col("other"))
        found = first.unionByName(searched(asked.select(*rows.columns)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
