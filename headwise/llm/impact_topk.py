"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Vectors become whole numbers, floor(scale * x). They are dealt into blocks by a hash of their id; queries visit every block
(a stated query set against all rows, in blocks). Inside a block every dimension has a posting list cut into segments of
quantised value; for a query a segment's impact is the most it can add beyond the least any segment of its dimension adds.
Segments are processed by descending impact, whatever their dimension. After every round each vector has an upper bound
(impacts seen, plus the next impact of every dimension not seen yet), and a floor is known: the k-th best exact score of the
vectors in front. Processing stops only when the vectors whose bound reaches the floor - the possible members, proven to
contain the block's part of the answer - are fewer than it would cost to go on; those are rescored exactly. The k best of
each block are merged by query.

Defined results: vectors that are null or hold a null or non-finite component, and rows without id, take no part; vectors of
unequal length are compared on their common components; repeated rows are candidates each, repeated query ids ask once (the
least vector of that id), a query never lists rows of its own id; ties go to the smaller id; with fewer than k candidates
all are listed; an empty table gives an empty result; other columns are ignored, whatever their names. Scores are exact while inner products fit into 53 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS, ROUNDS = 16, 8
LEAST_BLOCK, LARGEST_BLOCK = 2048, 65536


class ImpactIndex:
    """Posting segments of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        level = (vectors - low) * LEVELS // (high - low + 1)
        key = (np.arange(dims) * LEVELS + level).T.ravel()  # dimension by dimension
        order = np.argsort(key, kind="stable")
        self.postings = np.tile(np.arange(n), dims)[order]
        ranked = key[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
        self.start, self.length = first, np.diff(np.concatenate([first, [len(ranked)]]))
        self.dim = ranked[first] // LEVELS if len(ranked) else np.zeros(0, int)
        values = vectors.T.ravel()[order]
        self.least = np.minimum.reduceat(values, first) if len(ranked) else np.zeros(0, int)
        self.most = np.maximum.reduceat(values, first) if len(ranked) else np.zeros(0, int)

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.rint(self.vectors[rows].astype(float) @ query.astype(float)).astype(np.int64)

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of the block without ``own_id``, ties to the smaller id."""
        n, dims = self.vectors.shape
        q = np.zeros(dims, dtype=np.int64)
        q[:min(dims, len(query))] = query[:dims]
        valid = self.ids != own_id
        possible = np.flatnonzero(valid)
        if len(possible) > 4 * k and len(self.start):
            weight = q[self.dim]
            reach = np.maximum(weight * self.least, weight * self.most)
            floor = np.full(dims, np.iinfo(np.int64).max)
            np.minimum.at(floor, self.dim, reach)
            impact = (reach - floor[self.dim]).astype(float)
            order = np.argsort(-impact, kind="stable")
            order = order[impact[order] > 0]
            passed = np.cumsum(self.length[order])
            cuts = np.searchsorted(passed, passed[-1] * np.arange(1, ROUNDS + 1) / ROUNDS) + 1 if len(order) else []
            base, score, seen, low = float(floor.sum()), np.zeros(n), np.zeros((n, dims), dtype=np.float32), 0
            for cut in cuts:
                own = order[low:cut]
                low = cut
                size = self.length[own]
                if not size.sum():
                    continue
                at = np.repeat(self.start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                rows = self.postings[at]
                score += np.bincount(rows, weights=np.repeat(impact[own], size), minlength=n)
                seen[rows, np.repeat(self.dim[own], size)] = 1
                ahead = np.zeros(dims)
                np.maximum.at(ahead, self.dim[order[low:]], impact[order[low:]])
                bound = base + score + ahead.sum() - (seen @ ahead.astype(np.float32)).astype(float) + 1 + 1e-5 * ahead.sum()
                bound[~valid] = -np.inf
                front = np.argpartition(-bound, 2 * k)[:2 * k]
                front = front[valid[front]]
                scores = np.sort(self.exact(q, front))
                if len(scores) < k:
                    continue
                possible = np.flatnonzero(bound >= scores[-k])
                if len(possible) * dims <= self.length[order[low:]].sum() + 8 * k * dims:
                    break
        scores = self.exact(q, possible)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible[best]], scores[best]


def whole_vectors(frame: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id and vector of floor(scale * x), x as double, for rows that take part."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)).select(
        "id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))


def search(frame: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that meets ``is_query`` (a condition on ``id``)."""
    vectors = whole_vectors(frame, id_column, vector_column, scale)
    width = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = vectors.count()
    blocks = max(1, -(-total // min(LARGEST_BLOCK, max(LEAST_BLOCK, total // (4 * width)))))
    queries = vectors.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    dealt = vectors.select(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("block"),
                           F.lit(0).alias("kind"), "id", "vector").unionByName(
        queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "vector"))

    def answered(batches):
        block, index, ids, vectors = None, None, [], []
        for batch in batches:
            rows, marks = batch.column("vector").values.to_numpy(), batch.column("vector").offsets.to_numpy()
            out = ([], [], [])
            for i, (b, kind, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "id")))):
                vector = rows[marks[i]:marks[i + 1]]
                if b != block:
                    block, index, ids, vectors = b, None, [], []
                if kind == 0:
                    ids.append(own)
                    vectors.append(vector.copy())
                    continue
                if index is None:
                    dims = max(map(len, vectors), default=0)
                    matrix = np.zeros((len(ids), dims), dtype=np.int64)
                    for r, v in enumerate(vectors):
                        matrix[r, :len(v)] = v
                    index, vectors = ImpactIndex(np.array(ids, dtype=np.int64), matrix), []
                if len(index.ids):
                    found, scores = index.search(own, vector, k)
                    out[0].extend([own] * len(found))
                    out[1].extend(found.tolist())
                    out[2].extend(scores.tolist())
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = dealt.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(
        answered, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
