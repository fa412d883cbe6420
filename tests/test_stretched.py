"""Exponents of whole series and of resamples from stretches, at any size of arrays and stretches."""
import numpy as np
import pytest

from tidemill.operators import hurst, stretched

from .test_series import dfa_loop, frame


def exponents(f):
    return {r["resample"]: r["hurst"] for r in hurst.exponent(f, ["series_id", "resample"]).collect()}


@pytest.mark.parametrize(("size", "stretch"), [(7, 20), (64, 100), (4096, 65536)])
def test_stretches_merge_to_the_whole(spark, size, stretch):
    r = np.random.default_rng(size).normal(0.3, 1, 331)
    f, series = stretched.fluctuations(frame(spark, r, "log_return"), "log_return", ["series_id"], "bar_idx", 3, hurst.LEAST_BOX, hurst.BOXES, 40, size, stretch)
    found = exponents(f)
    want = {-1: dfa_loop(r), **{k: dfa_loop(hurst.pieced_series(r, k)) for k in range(3)}}
    assert found == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    assert series.first()["n"] == 331


def test_no_row_holds_a_series(spark):
    r = np.random.default_rng(1).normal(size=1000)
    parts, sums = stretched.arrays(frame(spark, r, "log_return"), "log_return", ["series_id"], "bar_idx", 64)
    rows = stretched.slices(parts, sums, ["series_id"], 5, 64, 128).collect()
    assert max(len(x["values"]) for x in rows) <= 64
    held = {}
    for x in rows:
        held.setdefault((x["resample"], x["stretch"]), []).extend(x["values"])
    assert max(map(len, held.values())) <= 128 + hurst.block_size(1000)
    for k in range(-1, 5):
        laid = np.concatenate([x["values"] for x in sorted((x for x in rows if x["resample"] == k), key=lambda x: x["pos"])])
        assert np.array_equal(laid, r if k < 0 else hurst.pieced_series(r, k))


def test_nulls_short_constant_and_keyless(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.normal(size=120))] + [(None, i, float(x)) for i, x in enumerate(rng.normal(size=60))]
    rows += [("a", 120 + i, None) for i in range(5)] + [("short", i, 1.0) for i in range(12)] + [("flat", i, 0.0) for i in range(80)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "series_id string, bar_idx bigint, log_return double")
    got = {r["series_id"]: r for r in hurst.series_interval(df, resamples=4).collect()}
    assert set(got) == {"a", None, "short", "flat"}
    assert got["a"]["hurst"] == pytest.approx(dfa_loop(np.array([x for s, _, x in rows if s == "a" and x is not None])), rel=1e-9)
    assert got[None]["resamples"] == 4 and got[None]["hurst"] is not None
    assert all((got[k]["hurst"], got[k]["ci_low"], got[k]["resamples"]) == (None, None, 0) for k in ("short", "flat"))
    assert hurst.series_interval(df.limit(0)).count() == 0
