"""Expanding aggregates of long series in two levels: within blocks of rows, and over one row a block.

A frame that begins at a series' first row puts the whole series into one task. Here a task has a block: block totals are
reduced first, the totals before a block are carried along a table of one row a (series, block), and enter the block as a row
ahead of its first. Sums, counts, extremes, first and last values merge that way; averages and moments are made of them.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block where the order counts rows.
BLOCK = 1 << 16
_PICKED = {"first", "last"}


def _merge(kind: str, c: Column, at: Column) -> Column:
    """As an aggregation."""
    if kind in _PICKED:
        pick = F.min_by if kind == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), at))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c)


def _over(kind: str, c: Column, w) -> Column:
    if kind in _PICKED:
        return (F.first if kind == "first" else F.last)(c, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c).over(w)


def running(df: DataFrame, values: Mapping[str, tuple[str, Column]], keys: Sequence[str], order: str, block: int | Column = BLOCK) -> DataFrame:
    """Adds, for each name, the aggregate of all rows up to this one by ``order``: (kind, column) with kind sum, max, min, first or last.

    Nulls are skipped; without a value so far the result is null. block: rows of a block where order counts rows, or a column
    that grows with the order. Rows of equal order come in any order. Keys may be null.
    """
    columns = df.columns
    df = df.withColumn("__block", F.floor(F.col(order) / block) if isinstance(block, int) else block)
    df = df.withColumns({f"__v_{n}": c for n, (_, c) in values.items()})
    names = {n: f"__v_{n}" for n in values}
    ahead = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__block").agg(*(_merge(kind, F.col(names[n]), F.col(order)).alias(names[n]) for n, (kind, _) in values.items()))
    carried = totals.select(*keys, "__block", F.lit(False).alias("__row"), *(_over(kind, F.col(names[n]), ahead).alias(names[n]) for n, (kind, _) in values.items()))
    both = df.withColumn("__row", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__block").orderBy("__row", order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({n: _over(kind, F.col(names[n]), inside) for n, (kind, _) in values.items()}).where("__row")
    return out.select(*(c for c in columns if c not in values), *values)


def numbered(df: DataFrame, ts: str, keys: Sequence[str], tie: str | None = None, out: str = "bar_idx", stretch: str = "month", span: int = BLOCK) -> DataFrame:
    """Adds the number of each row of its series from 0 by ts (ties by another column if one is given): rows are numbered within
    stretches (a unit of time, or a span of times that are numbers) from how many there are before."""
    timed = df.schema[ts].dataType.typeName().startswith(("timestamp", "date"))
    at = F.date_trunc(stretch, F.col(ts)) if timed else F.floor(F.col(ts) / span)
    columns = [c for c in df.columns if c != out]
    df = df.select(*columns).withColumn("__stretch", at)
    ahead = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n")).select(*keys, "__stretch", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n"), F.lit(False).alias("__row"))
    both = df.withColumns({"__row": F.lit(True), "__n": F.lit(1).cast("bigint")}).unionByName(before, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__stretch").orderBy("__row", *([ts, tie] if tie else [ts])).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, (F.sum("__n").over(inside) - 1).cast("bigint")).where("__row").select(*columns, out)
