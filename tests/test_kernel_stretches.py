"""Kernel estimates over several stretches, with nulls and other columns, against loops."""
import numpy as np
import pytest

from tidemill.operators import kernel

SCHEMA = "series_id string, bar_idx bigint, close double, note array<string>, at timestamp_ntz"


def loop(y, w, ahead):
    out = []
    for i, own in enumerate(y):
        before = [v for v in y[max(0, i - len(w) + 1) : i + (not ahead)][::-1] if v is not None]
        after = [v for v in y[i + 1 : i + len(w)] if v is not None] if ahead else []
        pairs = [(v, w[k + ahead]) for side in (before, after) for k, v in enumerate(side)] + ([(own, w[0])] if ahead and own is not None else [])
        out.append(sum(v * x for v, x in pairs) / sum(x for _, x in pairs) if pairs and not (ahead and own is None) else None)
    return out


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("holes", [(), (0, 7, 8, 50)])
def test_estimates_over_stretches(spark, monkeypatch, ahead, holes):
    monkeypatch.setattr(kernel, "STRETCH", 16)
    walk = [None if i in holes else float(x) for i, x in enumerate(np.random.default_rng(3).normal(size=90).cumsum())]
    rows = [(s, i, v, ["x", None], None) for s in ("a", None) for i, v in enumerate(walk)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = kernel.two_sided_estimate if ahead else kernel.causal_estimate
    got = run(df, 3)
    assert got.columns == [*df.columns, "estimate"]
    want = loop(walk, kernel.weights(3), ahead)
    for s in ("a", None):
        mine = sorted((r for r in got.collect() if r["series_id"] == s), key=lambda r: r["bar_idx"])
        assert [r["note"] for r in mine] == [["x", None]] * 90 and [r["close"] for r in mine] == walk
        assert [r["estimate"] for r in mine] == [None if v is None else pytest.approx(v, rel=1e-10, abs=1e-12) for v in want]
    assert run(df.limit(0), 3).count() == 0
