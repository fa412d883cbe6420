"""Window frames and row identity of keyed series: every operator orders by an explicit column within explicit keys."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS, ORDER = ("series_id",), "bar_idx"


def ordered(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def expanding(keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, keys: Sequence[str] = KEYS, order: str = ORDER) -> WindowSpec:
    """The last n rows, the current one included."""
    if n < 1:
        raise ValueError(f"a window needs at least one row, got {n}")
    return ordered(keys, order).rowsBetween(-(n - 1), 0)


def with_bar_index(df: DataFrame, ts: str, keys: Sequence[str] = KEYS, tie: str | None = None) -> DataFrame:
    """bar_idx from 0 in the order of ts within each series; ties by another column if one is given. A task numbers a month."""
    from .prefix import numbered

    return numbered(df, ts, keys, tie, ORDER)


def spread(df: DataFrame, *columns: str, least: int = 64) -> DataFrame:
    """Dealt by columns into a fixed number of tasks, before groups that are small to read and dear to compute: adaptive
    execution sizes tasks by bytes and would run all of them one after another."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), *columns)


#: Rows up to which a table of choices is held by the driver, and broadcast.
SMALL = 100_000


def settled(df: DataFrame) -> DataFrame:
    """A small table worked out once: later plans read its rows instead of computing them again. A larger one is kept by the executors."""
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        return df.persist()
    out = df.sparkSession.createDataFrame(rows, df.schema)
    out._tidemill_small = True
    return out


def small(df: DataFrame) -> bool:
    return getattr(df, "_tidemill_small", False)


def nan_as_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def guarded(ready: Column, value: Column) -> Column:
    """Null until enough rows are there."""
    return F.when(ready, value)
