import hashlib
import math

import numpy as np
import pytest

from tidemill.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, id string, v int, cluster string"


def table(spark, rows):
    """Embeddings with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, "x", 9, "y") for i, v in rows], SCHEMA)


def brute(rows, dim, k=8, rounds=10, resolution=1024, seed=3):
    good = [(i, [math.floor(resolution * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda v: min(range(len(cents)), key=lambda z: (away(v, cents[z]), z))
    for _ in range(rounds):
        at = [place(v) for _, v in good]
        for z in range(len(cents)):
            own = [v for (_, v), a in zip(good, at) if a == z]
            if own:
                cents[z] = [sum(c) // len(own) for c in zip(*own)]
    out, per = [], {}
    for i, v in good:
        z = place(v)
        out.append((i, z, away(v, cents[z])))
        per[z] = per.get(z, 0) + away(v, cents[z])
    return sorted(((-1 if i is None else i), z, d, per[z], sum(per.values()), hashlib.sha256(",".join(map(str, cents[z])).encode()).hexdigest()) for i, z, d in out)


def ours(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_whole_result_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    near = np.concatenate([rng.normal(m, 0.2, (60, 6)) for m in (-2, 0, 2)] + [np.round(rng.normal(0, 1, (60, 6)))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near)] + [(500 + i, [1.0] * 6) for i in range(90)]  # a third are one vector
    assert ours(C.cluster(table(spark, rows), dim=6)) == brute(rows, 6)


def test_odd_vectors(spark):
    rows = [(1, [0.5, -0.5]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0]), (1, [0.5, -0.5]), (1, [0.25, 3.0]), (None, [1.0, 1.0]), (9, [-0.0001, 0.0001])]
    assert ours(C.cluster(table(spark, rows), k=3, rounds=4, dim=2)) == brute(rows, 2, 3, 4)
    assert ours(C.cluster(table(spark, rows), k=50, rounds=2, dim=2)) == brute(rows, 2, 50, 2)
    empty = C.cluster(table(spark, rows).limit(0), dim=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="OverflowError"):
        C.cluster(table(spark, [(1, [1e30, 0.0])]), dim=2).collect()


@pytest.mark.parametrize("spread", [1, 40, 1 << 20])
def test_trees_settle_as_brute_force_does(spread):
    """Small ranges are full of ties, large ones leave double precision."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (700, 5))
    x[100:300] = x[7]
    tree = C.Tree.built(np.arange(700), np.ones(700, bool), x, leaf=8)
    n = tree.nodes
    assert (n["last"] - n["first"])[0] == 700 and (n["sums"][0] == x.sum(axis=0)).all()
    cents = np.concatenate([x[[3, 7, 7, 650]], rng.integers(-spread, spread + 1, (4, 5))])
    z, d = tree.assigned(cents)
    away = ((tree.x[:, None] - cents) ** 2).sum(axis=2)
    assert (z == away.argmin(axis=1)).all() and (d == away.min(axis=1)).all()
    counts, sums = np.zeros(8, np.int64), np.zeros((8, 5), np.int64)
    tree.add(cents, counts, sums)
    assert (counts == np.bincount(z, minlength=8)).all()
    assert all((sums[i] == tree.x[z == i].sum(axis=0)).all() for i in range(8))


def test_far_groups_are_assigned_as_nodes():
    """Groups that lie apart are settled above the leaves: no vector is compared by itself."""
    rng = np.random.default_rng(1)
    far = (0, 100_000, 200_000, 300_000)
    x = np.concatenate([rng.integers(0, 50, (300, 4)) + c for c in far])
    tree = C.Tree.built(np.arange(1200), np.ones(1200, bool), x)
    nodes, clusters, single = tree.settle(np.array([[c] * 4 for c in far]))
    assert (single == -1).all() and len(nodes) == 4 and sorted(clusters.tolist()) == [0, 1, 2, 3]


def test_trees_of_a_partition_hold_all_rows(spark):
    rows = spark.range(1000).selectExpr("id", "array(id, -id) v").coalesce(1)
    got = C.trees(rows, 2, size=64)
    assert sorted(i for r in got.collect() for i in np.frombuffer(r.ids, np.int64)) == list(range(1000))
    assert max(r.n for r in got.collect()) == 64
