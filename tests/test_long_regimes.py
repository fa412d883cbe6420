"""Block scans and fits over tasks against the recursions row by row."""
import math

import numpy as np
import pytest

from tests import sequential
from tidemill.operators import blockscan, long_regimes, regimes
from tidemill.operators.blockscan import Blocks


def path(n, seed=0):
    rng = np.random.default_rng(seed)
    s = np.cumsum(rng.random(n) < 0.02) % 3
    return rng.standard_t(5, n) * np.array([0.01, 0.03, 0.005])[s] + np.array([0.002, -0.003, 0.0])[s]


def near(got, want, eps=1e-9):
    for g, w in zip(got, want):
        g, w = np.asarray(g, np.float64), np.asarray(w, np.float64)
        finite = np.isfinite(w)
        assert (np.isfinite(g) == finite).all() and (np.abs(g - w)[finite] <= eps * np.maximum(1, np.abs(w[finite]))).all()


@pytest.mark.parametrize("student", [True, False])
@pytest.mark.parametrize("n", [3, 8, 50, 613])
def test_fits_equal_the_recursion_row_by_row(n, student):
    x = path(n, n)
    for got, want in zip(regimes.fit_many(x, [1, 2, 3], student, 40), sequential.fit_many(x, [1, 2, 3], student, 40)):
        near(got, want)


@pytest.mark.parametrize("length", [1, 4, 7, 300])
def test_any_cut_gives_the_same_states(length):
    x, pi = path(103, 4), np.array([0.2, 0.5, 0.3])
    a, mu, var, nu = np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.0, 0.3, 0.7]]), np.array([0.002, -0.003, 0.0]), np.array([1e-4, 9e-4, 2e-5]), np.array([5.0, 4.0, np.inf])
    logb = regimes.log_emissions(x, mu, var, nu)
    at = Blocks.cut(x, length)
    own = regimes.log_emissions(at.x, *(z[None] for z in (mu, var, nu)))
    b, top = blockscan.scaled(own)
    ahead, behind, score = blockscan.carries(pi[None], *blockscan.products(a[None], b, at))
    alpha, _, want = sequential.forward(pi, a, logb)
    assert score[0] + top[:, :, 0][at.valid].sum() == pytest.approx(want, abs=1e-9)
    assert at.flat(blockscan.filtered(ahead, a[None], b, at))[:, 0] == pytest.approx(alpha, abs=1e-12)
    gamma = alpha * sequential.backward(a, logb, sequential.forward(pi, a, logb)[1])
    both = blockscan.filtered(ahead, a[None], b, at) * blockscan.following(behind, a[None], b, at)
    both = at.flat(both / both.sum(axis=-1, keepdims=True))[:, 0]
    assert both == pytest.approx(gamma / gamma.sum(axis=1, keepdims=True), abs=1e-12)


def test_best_paths():
    for seed in range(20):
        x = path(5 + 13 * seed, seed)
        pi, a, mu, var, nu, _ = regimes.fit_once(x, seed, rounds=5)
        if np.isfinite(mu).all():
            assert (regimes.best_path(x, pi, a, mu, var, nu) == sequential.viterbi(pi, a, regimes.log_emissions(x, mu, var, nu))).all()


def rows_of(spark, series):
    """Rows with gaps in their numbers, as null returns leave them."""
    return spark.createDataFrame([(k, 0, 2 * i + (i > 100), float(v)) for k, x in series.items() for i, v in enumerate(x)], "series_id string, fold int, __i long, __x double")


def test_fits_over_tasks_equal_fits_in_one(spark):
    series = {"A": path(700, 1), "B": path(333, 2)}
    got = long_regimes.fit_blocks(rows_of(spark, series), ["series_id", "fold"], [4, 5], rounds=8, block=64).collect()
    assert {(r["series_id"], r["start"]) for r in got} == {("A", 0), ("A", 1), ("B", 0), ("B", 1)}
    want = {k: regimes.fit_many(x, [4, 5], rounds=8) for k, x in series.items()}
    for r in got:
        pi, a, mu, var, nu, score = want[r["series_id"]][r["start"]]
        near((r["pi"], r["a"], r["mu"], r["var"], r["nu"], r["score"]), (pi, a.ravel(), mu, var, nu, score))


@pytest.mark.parametrize("how", ["filter", "viterbi"])
def test_long_series_are_decoded_as_short_ones(spark, how, monkeypatch):
    x = {"A": path(700, 1), "B": path(90, 2)}
    df = spark.createDataFrame([(k, i, None if i == 0 else float(v)) for k, s in x.items() for i, v in enumerate(s)], "series_id string, bar_idx long, log_return double")
    monkeypatch.setattr(long_regimes, "BLOCK", 64)
    models = regimes.fit(df, starts=[1, 2], rounds=6)
    far = regimes.fit(df, starts=[1, 2], rounds=6, long=500)
    for a, b in zip(models.orderBy("series_id").collect(), far.orderBy("series_id").collect()):
        near((a["mu"], a["var"], a["nu"]), (b["mu"], b["var"], b["nu"]))
    told = lambda d: sorted(map(tuple, d.select("series_id", "bar_idx", "state", "regime").collect()))
    assert told(regimes.decode(df, models, how)) == told(regimes.decode(df, models, how, long=500))
    table = regimes.folds(df, 3)
    folded = regimes.fit(df, fold_table=table, starts=[1], rounds=3)
    assert told(regimes.decode(df, folded, how, fold_table=table)) == told(regimes.decode(df, folded, how, fold_table=table, long=300))


def test_a_task_holds_blocks(spark):
    rows = rows_of(spark, {"A": path(1000)})
    blocks = long_regimes.blocks_of(rows, ["series_id", "fold"], 64).orderBy("block").collect()
    assert max(len(r["x"]) for r in blocks) <= 64 and [r["first"] for r in blocks] == [True] + [False] * (len(blocks) - 1)
    assert [v for r in blocks for v in r["x"]] == path(1000).tolist() and blocks[-1]["start"] + len(blocks[-1]["x"]) == 1000
    assert math.isclose(sum(map(len, (r["bar_idx"] for r in blocks))), 1000)
