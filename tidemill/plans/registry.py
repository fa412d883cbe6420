"""How plan modules list their queries."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Queries = dict[str, tuple[Callable, str | None]]


def query(found: Queries, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with equivalent SQL if there is any."""

    def keep(f: Callable) -> Callable:
        found[f.__name__] = (f, sql)
        return f

    return keep


def rounded(df: DataFrame, digits: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles to so many digits: engines add in different orders. A negative zero becomes zero."""
    names = [c for c, kind in df.dtypes if kind == "double" and (columns is None or c in columns)]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})
