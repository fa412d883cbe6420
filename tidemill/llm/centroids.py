"""Operator 12: centroid clustering by kd-tree filtering.

Vectors become whole numbers, floor(resolution * x). Every partition packs its vectors into kd-trees of a bounded number of
vectors (split at the median of the widest side of the box), stored once; a node holds its count, the sum of its vectors and
its box, all in whole numbers. In a round the centroids go down each tree, a level of nodes at a time: of the candidates of a
node the one nearest to the middle of its box dominates another when every point of the box is strictly nearer to it; a
dominated one is pruned. A node that one candidate is left of is assigned whole, by its count and sum; the vectors of a leaf
are compared with what is left of the candidates exactly. Each task adds its trees up before anything is shuffled: a round
moves clusters x components sums a task, and the driver sees clusters x components numbers.

All of it is exact: distances are whole numbers below 2^53 in double precision or else in 64-bit integers, ties go to the
smaller number, and a new centroid is the exact floor of its mean.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part; components whose
squared distances would not fit 64 bits raise OverflowError; rows that repeat an id take part each; of rows with equal hashes
(one id) the smaller vector starts first, rows without an id start last; fewer vectors than clusters give fewer clusters; an
empty cluster keeps its centroid; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, stored, trimmed

#: Vectors of one tree and of one leaf at most.
TREE, LEAF = 16_384, 32
#: Components stay below this, so that squared distances of up to 2^8 components fit 64 bits, doubled boxes included.
LARGEST = 1 << 25
NODES = ("first", "last", "left", "low", "high", "sums")
ROW = "n int, ids binary, known binary, vectors binary, " + ", ".join(f"{x} binary" for x in NODES)


class Tree:
    """A kd-tree of whole-number vectors: arrays over its nodes, children of node i at left[i] and left[i] + 1 (left 0: a leaf)."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, x: np.ndarray, nodes: dict[str, np.ndarray]) -> None:
        self.ids, self.known, self.x, self.nodes = ids, known, x, nodes

    @classmethod
    def built(cls, ids: np.ndarray, known: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes, todo, at = np.arange(len(x)), {k: [] for k in NODES}, [(0, len(x))], 0
        while at < len(todo):
            a, b = todo[at]
            own = x[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            left, side = 0, int(np.argmax(high - low))
            if b - a > leaf and high[side] > low[side]:  # equal vectors are one leaf, however many
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], middle, kind="introselect")]
                left = len(todo)
                todo += [(a, a + middle), (a + middle, b)]
            for k, v in zip(NODES, (a, b, left, low, high, own.sum(axis=0))):
                nodes[k].append(v)
            at += 1
        return cls(ids[order], known[order], x[order], {k: np.array(v, np.int64) for k, v in nodes.items()})

    def row(self) -> list:
        return [len(self.x), *(z.tobytes() for z in (self.ids, self.known, self.x.astype(np.int32))), *(self.nodes[k].tobytes() for k in NODES)]

    @classmethod
    def read(cls, row: dict, dim: int) -> Tree:
        whole = {k: np.frombuffer(row[k], np.int64) for k in NODES}
        shaped = {k: v.reshape(-1, dim) if k in ("low", "high", "sums") else v for k, v in whole.items()}
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["vectors"], np.int32).reshape(-1, dim).astype(np.int64), shaped)

    def settle(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes assigned whole (node, cluster); and of the other vectors a cluster each: (rows, clusters) as one array of the tree's length, -1 for rows of whole nodes."""
        n, k = self.nodes, len(centroids)
        frontier, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        whole_nodes, whole_clusters, single = [], [], np.full(len(self.x), -1, np.int64)
        while len(frontier):
            low, high = n["low"][frontier], n["high"][frontier]
            best = np.argmin(np.where(alive, squares(low + high, 2 * centroids), np.iinfo(np.int64).max), axis=1)
            for z in range(k):
                rows = np.flatnonzero(alive[:, z] & (best != z))
                if not len(rows):
                    continue
                star = centroids[best[rows]]
                corner = np.where(centroids[z] > star, high[rows], low[rows])  # the point of the box that z has most of
                alive[rows, z] = ((corner - centroids[z]) ** 2).sum(axis=1) <= ((corner - star) ** 2).sum(axis=1)
            done = alive.sum(axis=1) == 1
            whole_nodes.append(frontier[done]), whole_clusters.append(best[done])
            leaves = ~done & (n["left"][frontier] == 0)
            for node, ok in zip(frontier[leaves].tolist(), alive[leaves]):
                a, b, some = n["first"][node], n["last"][node], np.flatnonzero(ok)
                single[a:b] = some[np.argmin(squares(self.x[a:b], centroids[some]), axis=1)]
            inner = ~done & ~leaves
            left = n["left"][frontier[inner]]
            frontier, alive = np.concatenate([left, left + 1]), np.concatenate([alive[inner], alive[inner]])
        return np.concatenate(whole_nodes), np.concatenate(whole_clusters), single

    def add(self, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add the count and the sum of each cluster's vectors."""
        nodes, clusters, single = self.settle(centroids)
        np.add.at(counts, clusters, self.nodes["last"][nodes] - self.nodes["first"][nodes])
        np.add.at(sums, clusters, self.nodes["sums"][nodes])
        for z in range(len(centroids)):
            own = self.x[single == z]
            counts[z] += len(own)
            sums[z] += own.sum(axis=0)

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every vector."""
        nodes, clusters, out = self.settle(centroids)
        for node, z in zip(nodes.tolist(), clusters.tolist()):
            out[self.nodes["first"][node] : self.nodes["last"][node]] = z
        return out, ((self.x - centroids[out]) ** 2).sum(axis=1)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exactly: by products where double precision holds every one of them, else term by term."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - z) ** 2).sum(axis=1) for z in c], axis=1)


def trees(vectors: DataFrame, dim: int, size: int = TREE) -> DataFrame:
    """vectors (id, v: array<long>): stored rows of packed trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            row = Tree.built(*(np.concatenate(z) for z in zip(*held))).row()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([z], pa.binary()) for z in row[1:])], [x.split()[0] for x in ROW.split(", ")])

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise OverflowError(f"components of {LARGEST} or more have squared distances beyond 64 bits")
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            a = 0
            while a < len(x):
                take = size - sum(len(h[0]) for h in held)
                held.append((ids[a : a + take], known[a : a + take], x[a : a + take]))
                a += take
                if sum(len(h[0]) for h in held) >= size:
                    yield packed()
        if held:
            yield packed()

    return stored(vectors.mapInArrow(run, ROW), "kd-trees")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [r.v for r in vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()]


def floored(vectors: DataFrame, id_col: str, vector_col: str, dim: int, resolution: int) -> DataFrame:
    """id, v: whole numbers of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where((F.size("v") == dim) & ~F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))))
    # A double beyond 64 bits saturates here and is refused when its tree is built.
    return good.select("id", F.transform("v", lambda a: F.floor(F.greatest(F.least(a * resolution, F.lit(1e15)), F.lit(-1e15)))).alias("v"))


def packed_sums(centroids: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                Tree.read({n: b.column(i)[row].as_py() for i, n in enumerate(b.schema.names)}, dim).add(centroids, counts, sums)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return trimmed(run)


def fit(forest: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds over stored trees."""
    k, dim = centroids.shape
    for _ in range(rounds):
        parts = forest.mapInArrow(packed_sums(centroids, dim), "cluster int, n bigint, sums array<bigint>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
        new = centroids.copy()
        for r in each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            new[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])  # k x dim numbers
        centroids = new
    return centroids


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, resolution: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256: one row for each vector that takes part."""
    spark = vectors.sparkSession
    rows = floored(vectors, id_col, vector_col, dim, resolution)
    forest, starts = trees(rows, dim), first_centroids(rows, k, seed)
    if not starts:
        return rows.limit(0).selectExpr(f"id as {id_col}", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    with batch_rows(spark, 4):  # a tree is some MB
        centroids = fit(forest, np.array(starts, np.int64), rounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    t = Tree.read({n: b.column(i)[row].as_py() for i, n in enumerate(b.schema.names)}, dim)
                    z, d = t.assigned(centroids)
                    yield pa.RecordBatch.from_arrays([pa.array(t.ids, mask=~t.known), pa.array(z.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

        assigned = stored(forest.mapInArrow(trimmed(run), "id long, cluster int, distance long"), "clusters")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = {r["cluster"]: r["cluster_inertia"] for r in per.collect()}  # one row a cluster
    by = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return assigned.select(
        F.col("id").alias(id_col), "cluster", "distance", by([total.get(z, 0) for z in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(total.values())).cast("bigint").alias("inertia"), by(digests, "string").alias("centroid_sha256"),
    )
