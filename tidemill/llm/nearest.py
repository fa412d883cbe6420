"""Operator 4: nearest neighbours by a block matrix join with error bounds.

Vectors are packed into blocks of rows, each block quantised to int8 with a scale and a bound of the error for every vector.
Query blocks meet candidate blocks; the product of two int8 tiles gives all distances of the pair with bounds:
|q - c| lies within |q' - c'| +- (error of q + error of c), by the triangle inequality. A pair survives when its lower bound
does not pass the query's k-th smallest upper bound so far; survivors alone are computed again from the original vectors in
double precision and merged into a heap for each query. The result is exact (recall 1): the bounds only spare work.

Tiles are joined by block, not by row; the queries are a stated set (id divisible by ``every``) against all rows.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another length are
infinitely far; ties go to the smaller id; rows that repeat an id are candidates of their own (never of the query with that
id); rows that repeat a query's id are one query with one heap: of the distances of all of them the k smallest come back, so a
candidate may stand there once for each; a null id takes no part; fewer candidates than k give fewer rows; an empty table an empty result.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
BLOCK = "dim int, n int, ids binary, vectors binary, codes binary, scales binary, norms binary, errors binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the coded vector, and bound of the distance between a vector and its code."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, (coded * coded).sum(axis=1), np.sqrt(((x - coded) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-300


def usable(x: list | None) -> bool:
    return bool(x) and all(v is not None for v in x)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """vectors (id, v): stored rows of packed blocks, one length of vector each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dim: int) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(z) for z in zip(*held.pop(dim)))
            for at in range(0, len(ids), size):
                i, v = ids[at : at + size], np.ascontiguousarray(x[at : at + size])
                parts = [z.tobytes() for z in (i, v, *quantised(v))]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(i)], pa.int32()), *(pa.array([z], pa.binary()) for z in parts)], ["dim", "n", "ids", "vectors", "codes", "scales", "norms", "errors"])

        for b in batches:
            ids, column = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            dims = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[rows].astype(np.int64), x))
                if sum(len(z[0]) for z in held[dim]) >= size:
                    yield from packed(dim)
        for dim in list(held):
            yield from packed(dim)

    good = vectors.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))) & F.exists("v", lambda a: a != 0))
    return stored(good.mapInArrow(run, BLOCK), "blocks")


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows' Euclidean distances, summed in the order of components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        d = a[:, i] - b[:, i]
        total += d * d
    return np.sqrt(total)


class Heaps:
    """The k nearest of each query met so far, the farthest on top."""

    def __init__(self, k: int) -> None:
        self.k, self.of = k, {}

    def worst(self, query: int) -> float:
        h = self.of.get(query, ())
        return -h[0][0] if len(h) == self.k else np.inf

    def add(self, query: int, score: float, other: int) -> None:
        h, item = self.of.setdefault(query, []), (-score, -other)
        if len(h) < self.k:
            heapq.heappush(h, item)
        elif item > h[0]:
            heapq.heapreplace(h, item)


def tile(q: dict, c: dict, heaps: Heaps) -> None:
    """Merge the pairs of a query block and a candidate block that can matter."""
    dim, k = q["dim"], heaps.k
    of = lambda x, name, kind: np.frombuffer(x[name], kind)
    q_ids, c_ids = of(q, "ids", np.int64), of(c, "ids", np.int64)
    # Products of int8 codes are whole numbers below 2^24 in sum for up to 1040 components: float32 keeps them exactly.
    kind = np.float32 if dim <= 1040 else np.float64
    a, b = of(q, "codes", np.int8).reshape(-1, dim).astype(kind), of(c, "codes", np.int8).reshape(-1, dim).astype(kind)
    dots = (a @ b.T).astype(np.float64) * of(q, "scales", np.float64)[:, None] * of(c, "scales", np.float64)
    square = of(q, "norms", np.float64)[:, None] + of(c, "norms", np.float64) - 2 * dots
    slack = 1e-9 * (of(q, "norms", np.float64)[:, None] + of(c, "norms", np.float64))  # of rounding
    error = of(q, "errors", np.float64)[:, None] + of(c, "errors", np.float64)
    low = np.sqrt(np.maximum(square - slack, 0)) - error
    high = np.sqrt(np.maximum(square + slack, 0)) + error
    self_ = q_ids[:, None] == c_ids
    low[self_] = high[self_] = np.inf
    bound = np.array([heaps.worst(x) for x in q_ids.tolist()])
    if high.shape[1] > k:
        bound = np.minimum(bound, np.partition(high, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((low <= bound[:, None]) & ~self_)
    x, y = of(q, "vectors", np.float64).reshape(-1, dim), of(c, "vectors", np.float64).reshape(-1, dim)
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        for query, score, other in zip(q_ids[i[s]].tolist(), exact_distance(x[i[s]], y[j[s]]).tolist(), c_ids[j[s]].tolist()):
            heaps.add(query, score, other)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query its k nearest others by Euclidean distance."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    q = blocks(rows.where(F.col("id") % every == 0), QUERY_BLOCK)
    c = blocks(rows, CANDIDATE_BLOCK)
    q = q.select(*(F.col(x).alias(f"q_{x}") for x in q.columns))
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for b in batches:
            for row in range(b.num_rows):
                one = {n: b.column(i)[row].as_py() for i, n in enumerate(b.schema.names)}
                tile({n: one[f"q_{n}"] for n in names}, {n: one[n] for n in names}, heaps)
        for query, h in heaps.of.items():
            best = sorted((-s, -o) for s, o in h)
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(best), pa.int64()), pa.array([o for _, o in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], ["query_id", "vec_id", "score"])

    # Block rows of a few MB each: pairs of partitions are streamed, neither side is broadcast or held whole.
    pairs = q.join(c.hint("shuffle_replicate_nl"), q["q_dim"] == c["dim"])
    found = pairs.select(*(f"q_{n}" for n in names), *names).mapInArrow(run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
