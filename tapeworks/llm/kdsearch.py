"""Exact top-k inner-product search with a KD-tree per shard of candidates.

Each task cuts the candidates it reads into shards of bounded size and builds a KD-tree on each: median splits along
the widest dimension, tight bounding boxes. A query visits leaves best first, by the largest inner product that its
box allows; it stops when that bound is below the query's k-th score so far, which carries over from shard to shard.
Queries come in blocks of bounded size, one broadcast and one scan a block, so nothing grows with the data but the
number of blocks; the per-task results, k a query, are merged by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeworks.llm.common import materialize


class Tree:
    """KD-tree over integer vectors: float64 where all inner products are below 2**53, else int64."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, leaf: int = 256):
        nodes, self.left, self.right, self.rows = [], [], [], []
        stack = [(np.arange(len(ids)), -1, 0)]
        self.ids, self.vecs = ids, vecs
        while stack:
            rows, parent, side = stack.pop()
            at, own = len(nodes), vecs[rows]
            lo, hi = own.min(0), own.max(0)
            nodes.append((lo, hi))
            self.left.append(-1)
            self.right.append(-1)
            self.rows.append(None)
            if parent >= 0:
                (self.left, self.right)[side][parent] = at
            dim = int(np.argmax(hi - lo))
            if len(rows) <= leaf or hi[dim] == lo[dim]:
                self.rows[at] = rows[np.argsort(ids[rows], kind="stable")]
                continue
            order = np.argpartition(own[:, dim], len(rows) // 2)
            stack += [(rows[order[: len(rows) // 2]], at, 0), (rows[order[len(rows) // 2 :]], at, 1)]
        self.lo, self.hi = (np.array([n[i] for n in nodes]) for i in (0, 1))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        q, lo, hi = (x.astype(np.float64) for x in (queries, self.lo, self.hi))
        out = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
        return out if self.vecs.dtype == np.float64 else out + 1e-9 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1

    def search(self, query: np.ndarray, qid: int, bound: np.ndarray, best: list, k: int) -> None:
        """Update ``best``, a min-heap of (score, -id) with at most k entries, by the candidates of this tree."""
        heap = [(-bound[0], 0)]
        while heap:
            limit, at = heapq.heappop(heap)
            if len(best) == k and -limit < best[0][0]:
                return
            rows = self.rows[at]
            if rows is None:
                for child in (self.left[at], self.right[at]):
                    if len(best) < k or bound[child] >= best[0][0]:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = self.vecs[rows] @ query
            near = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(len(rows))
            if len(near) > 4 * k:  # only the k best of a leaf can matter; rows are in order of id
                near = near[np.lexsort((self.ids[rows[near]], -scores[near]))[: k + 1]]
            for i in near:
                if (cid := int(self.ids[rows[i]])) != qid:
                    item = (int(scores[i]), -cid)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)


def top_k(queries: DataFrame, candidates: DataFrame, dim: int, k: int = 10, shard_rows: int = 16_384, block_rows: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, ties to the smaller vec_id.

    Both tables have id (long) and vec (array of long, all of length ``dim``). A query's own id is no candidate. Repeated
    rows are candidates each, and a repeated query has one answer. Fewer candidates than k give fewer rows; empty tables
    give none. Vectors so large that a score may exceed a long are refused.
    """
    spark = queries.sparkSession
    queries = queries.dropDuplicates(["id"])
    largest = F.max(F.greatest(F.array_max("vec"), -F.array_min("vec"))).alias("x")
    count, most = queries.agg(F.count(F.lit(1)), largest).first()
    limit = dim * (most or 0) * (candidates.agg(largest).first()["x"] or 0)
    if limit >= 1 << 63:
        raise ValueError("inner products may exceed a long")
    number = np.float64 if limit < 1 << 53 else np.int64
    blocks = -(-count // block_rows)
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))), "kd-queries")
    found = None
    for n in range(max(1, blocks)):
        # a hash deals about block_rows to a block: bounded by block_rows x dim numbers, whatever the table
        block = queries.filter(F.col("block") == n).select("id", "vec").toArrow()
        qid = block["id"].to_numpy()
        qvec = np.array(block["vec"].combine_chunks().flatten(), dtype=number).reshape(len(qid), dim)
        sent = spark.sparkContext.broadcast((qid, qvec))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, qvec = sent.value
            best: list[list] = [[] for _ in qid]
            held, rows = [], 0

            def use() -> None:
                ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
                vecs = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]).astype(number).reshape(len(ids), -1)
                for at in range(0, len(ids), shard_rows):
                    tree = Tree(ids[at : at + shard_rows], vecs[at : at + shard_rows])
                    for q0 in range(0, len(qid), 1024):
                        for i, bound in enumerate(tree.bounds(qvec[q0 : q0 + 1024]), q0):
                            tree.search(qvec[i], int(qid[i]), bound, best[i], k)

            if len(qid):
                for b in batches:
                    if b.num_rows:
                        held.append(b)
                        rows += b.num_rows
                        if rows >= shard_rows:
                            use()
                            held, rows = [], 0
                if held:
                    use()
            flat = [(int(q), int(-c), int(s)) for q, heap in zip(qid, best, strict=True) for s, c in heap]
            for at in range(0, len(flat), 50_000):
                cols = list(zip(*flat[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        part = candidates.select("id", "vec").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int = 1024) -> DataFrame:
    """(id, vec): floor(scale * x) of each component; rows with null, null or non-finite components, or another length, go."""
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(ok & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
