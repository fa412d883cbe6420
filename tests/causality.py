"""A harness for causal operators: rows after a bar change, everything up to that bar must stay the same."""
from __future__ import annotations

import math


def same_before(operator, df, spiked, at: int, columns, order: str = "bar_idx") -> None:
    """operator: DataFrame -> DataFrame. df and spiked differ from bar ``at`` on. Companion: something after must differ."""
    a = {r[order]: [r[c] for c in columns] for r in operator(df).select(order, *columns).collect()}
    b = {r[order]: [r[c] for c in columns] for r in operator(spiked).select(order, *columns).collect()}
    assert a.keys() == b.keys() and a
    near = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12))
    for k in a:
        if k < at:
            assert all(near(x, y) for x, y in zip(a[k], b[k])), (k, a[k], b[k])
    assert any(not all(near(x, y) for x, y in zip(a[k], b[k])) for k in a if k >= at), "the spike changed nothing: the test is empty"
