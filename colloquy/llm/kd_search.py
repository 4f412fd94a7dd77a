"""Exact top-k search by inner product with a KD-tree per shard.

A shard is a run of at most `SHARD` vectors of one scan partition. Its tree halves the
vectors at the median of the widest side of their bounding box; every node keeps the tight
box of its vectors. A query is worked off best first: of a node no vector can score more
than the sum over the axes of the better corner, so nodes leave a heap by that bound, and
the search ends when the best bound left is below the query's kth score. That kth score
goes from shard to shard in a task, and starts from the scores among the queries of the
block themselves, which are candidates too.

Queries are taken in blocks of at most `BLOCK` vectors and sent to every shard: what a
task receives does not grow. Every shard returns k candidates a query at most; they are
ranked twice, per (query, salt) and then per query.

Results in special cases: vectors that are null, empty, or hold null or non-finite
components take no part; a null id takes no part as a query, and as a candidate it comes
last among equal scores; vectors of other lengths than the query's are no candidates. A
query is left out of its own candidates by id, so repeated rows of its id are too. Repeated
rows of a query are asked once; rows of one id with different vectors are queries each, under
that id. Repeated rows of another id are candidates each, told apart by their rank alone. Components are integers after `scale`; sums are exact while they stay below 2**53,
and a vector too large for that raises an error. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.ship import ship
from colloquy.session import materialise

SHARD = 16_384
LEAF = 128
BLOCK = 2_048
LIMIT = 2.0**53


class Tree:
    """Boxes and leaves over vectors, the widest axis cut at its median."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(vectors))
        low, high, self.child, self.span = [], [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            a, b, parent = todo.pop()
            part = vectors[self.order[a:b]]
            node = len(low)
            low.append(part.min(0))
            high.append(part.max(0))
            self.child.append([])
            self.span.append((a, b))
            if parent >= 0:
                self.child[parent].append(node)
            width = high[-1] - low[-1]
            axis = int(width.argmax())
            if b - a > LEAF and width[axis] > 0:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], middle)]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.vectors, self.ids = vectors[self.order], ids[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the most that a vector in the node's box can score."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int):
        """Yields (query's place, scores, ids) of candidates that reach the kth score; raises `kth` on the way."""
        bound = self.bounds(queries)
        for q in np.flatnonzero(bound[:, 0] >= kth):
            reach, best_scores, best_ids = bound[q], np.empty(0), np.empty(0, np.int64)
            heap, least = [(-reach[0], 0)], kth[q]
            while heap and -heap[0][0] >= least:  # an equal score may still have a smaller id
                _, node = heapq.heappop(heap)
                if self.child[node]:
                    for c in self.child[node]:
                        if reach[c] >= least:
                            heapq.heappush(heap, (-reach[c], c))
                    continue
                a, b = self.span[node]
                scores = self.vectors[a:b] @ queries[q]
                keep = np.flatnonzero((scores >= least) & (self.ids[a:b] != own[q]))
                if not len(keep):
                    continue
                best_scores = np.concatenate([best_scores, scores[keep]])
                best_ids = np.concatenate([best_ids, self.ids[a:b][keep]])
                if len(best_scores) > k:
                    top = np.lexsort((best_ids, -best_scores))[:k]
                    best_scores, best_ids = best_scores[top], best_ids[top]
                if len(best_scores) == k:
                    least = max(least, best_scores.min())
            kth[q] = least
            if len(best_scores):
                yield q, best_scores, best_ids


NO_ID = np.iinfo(np.int64).max  # stands for a null id, which is no one's own


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(1)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), flat.reshape(len(values), dim)


def scaled(vectors: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): every component x as floor(scale * x); vectors that take no part are left out."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("v"))


def _search_block(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, first: int) -> DataFrame:
    """Candidates of the block's queries, which are numbered from `first`, from every shard."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, queries))
    dim = queries.shape[1]

    def candidates(batches):
        own, q = sent.value
        kth = start(own, q)
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                held, matrix = _matrix(batch.slice(at, SHARD), dim)
                if not len(held):
                    continue
                if np.abs(matrix).max(initial=0) * np.abs(q).max(initial=0) * dim >= LIMIT:
                    raise ValueError("components too large for exact scores")
                hits = list(Tree(matrix, held).search(q, own, kth, k))
                if hits:
                    place, scores, found = (np.concatenate(x) for x in zip(*((np.full(len(s), i), s, f) for i, s, f in hits), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place + first), pa.array(own[place]), pa.array(found, mask=found == NO_ID), pa.array(scores.astype(np.int64))],
                        names=["_q", "query_id", "vec_id", "score"],
                    )

    def start(own, q):
        """The kth score among the block's own vectors of different ids: they are candidates, so no less will do."""
        kth = np.full(len(q), -np.inf)
        for at in range(0, len(q), 256):
            scores = q[at : at + 256] @ q.T
            scores[own[at : at + 256, None] == own[None, :]] = -np.inf
            if len(q) > k:
                kth[at : at + 256] = np.partition(scores, len(q) - k, axis=1)[:, len(q) - k]
        return kth

    fitting = rows.where(F.size("v") == dim)
    return fitting.mapInArrow(candidates, "_q long, query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The k best of each query: first per salt, so that no task holds all candidates of a query."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    part = F.row_number().over(Window.partitionBy("_q", "_salt").orderBy(*order))
    whole = F.row_number().over(Window.partitionBy("_q").orderBy(*order))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    best = salted.withColumn("_r", part).where(F.col("_r") <= k)
    return best.withColumn("rank", whole).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every row that `is_query` (a condition on `id`) names."""
    spark = vectors.sparkSession
    ship(spark)
    rows = scaled(vectors, scale, key, vector)
    asked = rows.where(F.col("id").isNotNull() & is_query).dropDuplicates(["id", "v"])
    # Blocks of queries of one length, cut by ranges of ids, so that a block is a narrow scan
    # of the table of queries and nothing but a block passes the driver.
    asked = materialise(asked.withColumn("d", F.size("v")).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "queries")
    counts = asked.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    blocks, asked_so_far = [], 0
    for c in counts:
        parts = -(-c["n"] // (BLOCK // 2))
        for i in range(parts):
            low, high = (i << 20) // parts, ((i + 1) << 20) // parts
            block = asked.where((F.col("d") == c["d"]) & (F.col("_part") >= low) & (F.col("_part") < high)).select("id", "v").toArrow()
            if not block.num_rows:
                continue
            block = block.combine_chunks().to_batches()[0]
            for at in range(0, block.num_rows, BLOCK):
                ids, matrix = _matrix(block.slice(at, BLOCK), c["d"])
                blocks.append(materialise(_search_block(rows, ids, matrix, k, asked_so_far), "candidates"))
                asked_so_far += len(ids)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = blocks[0]
    for more in blocks[1:]:
        found = found.unionAll(more)
    return ranked(found, k)
