"""Expanding aggregates over blocks against one window over each series, and keyed permutations against lists."""
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions.prefix import numbered, running
from tidemill.operators import bars, flow, permutation, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = [(k, i, None if rng.random() < 0.2 else float(rng.normal())) for k, n in (("A", 400), ("B", 3), (None, 150)) for i in range(n)]
    rng.shuffle(out)
    return spark.createDataFrame([(k, int(i), v) for k, i, v in out], "series_id string, bar_idx long, x double")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_equals_one_window(rows, block):
    kinds = {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "f": ("first", F.col("x")), "l": ("last", F.col("x")), "n": ("sum", F.lit(1))}
    w = Window.partitionBy("series_id").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("series_id", "bar_idx", F.sum("x").over(w).alias("s"), F.max("x").over(w).alias("hi"), F.min("x").over(w).alias("lo"), F.first("x", True).over(w).alias("f"), F.last("x", True).over(w).alias("l"), F.count("*").over(w).alias("n"))
    both = [sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr) for d in (running(rows, kinds, ["series_id"], "bar_idx", block).select(want.columns), want)]
    assert both[0] == both[1]


def test_rows_are_numbered_over_months(spark):
    rng = np.random.default_rng(2)
    days = rng.choice(900, 300, replace=False)
    df = spark.createDataFrame([(k, int(d), int(t)) for k in ("A", None) for d in days for t in rng.permutation(2)], "series_id string, d int, e int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    got = numbered(df, "ts", ["series_id"], "e").orderBy("series_id", "bar_idx").collect()
    assert [r["bar_idx"] for r in got] == list(range(600)) * 2
    assert all((a["d"], a["e"]) < (b["d"], b["e"]) for a, b in zip(got, got[1:]) if a["bar_idx"] + 1 == b["bar_idx"])


def test_no_task_has_a_whole_series(spark):
    """Windows over rows are by series and block; the one by series alone reads a row a block."""
    df = spark.createDataFrame([("A", i, float(i % 17), 0.001 * (i % 5)) for i in range(200_000)], "series_id string, bar_idx long, equity double, log_return double")
    for made in (stats.drawdown(df), bars.price_path(df, 100.0), stats.expanding_scales(df), flow.expanding_moments(df, ["equity", "log_return"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "__block" not in re.search(r"\], \[(.*?)\], \[", line)[1]:
                below = plan.splitlines()[plan.splitlines().index(line) + 1]
                assert "Aggregate" in below or "Project" in below and "Aggregate" in plan.splitlines()[plan.splitlines().index(line) + 2], line
    peaks = running(df, {"p": ("max", F.col("equity"))}, ["series_id"], "bar_idx")
    assert peaks.where("p = 16").count() == 200_000 - 16
    parts = peaks.groupBy(F.floor(F.col("bar_idx") / 65_536)).count().collect()
    assert len(parts) == 4


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_every_key_is_a_permutation(n):
    drawn = [permutation.permuted(np.arange(n), n, 3, k) for k in range(1, 6)]
    assert all(sorted(p.tolist()) == list(range(n)) for p in drawn)
    if n > 100:
        assert len({tuple(p) for p in drawn}) == 5
        assert all(abs(np.corrcoef(p, np.arange(n))[0, 1]) < 5 / np.sqrt(n) for p in drawn)


def test_places_are_spread_evenly():
    """Each of 6 rows comes to each of 6 places about as often."""
    met = np.zeros((6, 6))
    for k in range(3000):
        met[np.arange(6), permutation.permuted(np.arange(6), 6, 1, k)] += 1
    assert ((met - 500) ** 2 / 500).sum() < 70  # 25 degrees of freedom


def test_p_values_equal_a_loop_over_the_same_places(spark):
    rng = np.random.default_rng(5)
    data = {}
    for key, n in (("A", 230), ("B", 40), ("C", 9)):
        side = rng.choice([1, -1, 0], n, p=[0.3, 0.3, 0.4])
        side = np.zeros(n, int) if key == "C" else side
        up = (rng.random(n) < 0.5 + 0.15 * side).astype(float)
        toward = np.where(rng.random(n) < 0.7, (rng.random(n) < 0.6).astype(float), np.nan)
        data[key] = side, up, toward
    rows = [(k, 3 * i, int(s), float(u), None if np.isnan(t) else float(t)) for k, z in data.items() for i, (s, u, t) in enumerate(zip(*z))]
    df = spark.createDataFrame(rows, "series_id string, bar_idx long, side int, up double, toward double")
    got = {r["series_id"]: r for r in permutation.label_edges(df, 60, 4).collect()}
    for k, (side, up, toward) in data.items():
        n, known = len(side), ~np.isnan(toward)
        labels = np.array([1] * (side > 0).sum() + [-1] * (side < 0).sum() + [0] * (side == 0).sum())

        def edges(s):
            back = (s == 0) & known
            right = np.where(s > 0, up, 1 - up)[s != 0]
            return right.mean() - 0.5 if len(right) else np.nan, toward[back].mean() - 0.5 if back.any() else np.nan

        seen = edges(side)
        null = np.array([edges(labels[permutation.permuted(np.arange(n), n, 4, j)]) for j in range(1, 61)])
        for i, name in enumerate(("trend", "reversion")):
            if np.isnan(seen[i]):
                assert got[k][f"{name}_edge"] is None and got[k][f"{name}_p"] is None
                continue
            valid = null[:, i][~np.isnan(null[:, i])]
            assert got[k][f"{name}_edge"] == pytest.approx(seen[i])
            assert got[k][f"{name}_p"] == pytest.approx((1 + (valid >= seen[i] - 1e-12).sum()) / (1 + len(valid)))
        assert got[k]["n_trend"] == (side != 0).sum() and got[k]["n_reversion"] == ((side == 0) & known).sum()
