"""Detrended fluctuations of whole series and of their block resamples, from statistics of stretches that merge.

What is left of a line fitted to a running sum does not change when a line is added to the sum, so a stretch of a series can
start its own sum from 0: boxes inside it are done there, and of a box that reaches over its ends it hands on the count, the
means and the co-moments of its part. Parts meet when the sums of the stretches before them are known, one row a stretch. A
resample takes slices of arrays of ``ARRAY`` values; no row holds more than that, and no task more than a stretch.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import spread
from ..functions.prefix import numbered

#: Values of an array of the series, and about as many of a stretch.
ARRAY, STRETCH = 1 << 12, 1 << 16
#: A part: rows, mean place in its box, mean of the sum, co-moment of both, squares of the sum about its mean.
PART = ["c", "mt", "my", "sty", "syy"]


def box_sizes(n: int, least: int, boxes: int) -> np.ndarray:
    """Box sizes of a series of n values, from ``least`` to a quarter of it, evenly in logs; at least 4, and twice in the series."""
    if n < 4:
        return np.zeros(0, int)
    sizes = np.unique(np.rint(10 ** np.linspace(np.log10(least), np.log10(n // 4), boxes)).astype(int))
    return sizes[(sizes >= 4) & (n // np.maximum(sizes, 1) >= 2)]


def drawn_block(n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(10), F.rint(2 * F.pow(n.cast("double"), F.lit(1 / 3))))).cast("bigint")


def arrays(df: DataFrame, returns: str, keys: Sequence[str], order: str, size: int = ARRAY) -> tuple[DataFrame, DataFrame]:
    """(keys, part, values): the returns in order, ``size`` a row; (keys, n, m): how many a series has, and their mean. Nulls do not count."""
    rows = numbered(df.where(F.col(returns).isNotNull()).select(*keys, order, F.col(returns).cast("double").alias("__r")), order, keys, None, "__i")
    sorted_ = F.array_sort(F.collect_list(F.struct("__i", "__r")))
    parts = rows.groupBy(*keys, F.floor(F.col("__i") / size).alias("part")).agg(sorted_.alias("values")).withColumn("values", F.col("values.__r"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return parts, parts.groupBy(*keys).agg(F.sum(F.size("values")).alias("n"), F.sum(total).alias("m")).withColumn("m", F.col("m") / F.col("n"))


def slices(parts: DataFrame, sums: DataFrame, keys: Sequence[str], resamples: int, size: int = ARRAY, stretch: int = STRETCH) -> DataFrame:
    """keys, n, m, resample, stretch, pos, values: the series itself as resample -1, and the blocks of each resample where they are
    laid. Starts are hashes of (resample, place), so that SQL can draw them as well."""
    own = F.col("resample") < 0
    each = spread(sums.withColumn("resample", F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1)))), *keys, "resample")
    each = each.withColumn("block", F.when(own, F.lit(size).cast("bigint")).otherwise(drawn_block(F.col("n"))))
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("block")) - 1)))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", "resample", "k")), 1, 8), 16, 10).cast("bigint")
    each = each.withColumn("start", F.when(own, F.col("k") * F.col("block")).otherwise(hashed % F.greatest(F.col("n") - F.col("block") + 1, F.lit(1))))
    each = each.withColumn("end", F.col("start") + F.least("block", F.col("n") - F.col("k") * F.col("block")))
    each = each.withColumn("stretch", F.floor(F.col("k") / F.ceil(F.lit(stretch) / F.col("block"))))
    each = each.withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    low, high = F.greatest("start", F.col("at") * size), F.least("end", (F.col("at") + 1) * size)
    each = each.select(*(F.col(c).alias(f"__{c}") for c in keys), "n", "m", "resample", "stretch", (F.col("k") * F.col("block") + low - F.col("start")).alias("pos"), "at", (low - F.col("at") * size + 1).cast("int").alias("low"), (high - low).cast("int").alias("length"))
    met = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in keys]
    both = each.join(parts, [*met, F.col("at") == F.col("part")])
    return both.select(*keys, "n", "m", "resample", "stretch", "pos", F.slice("values", F.col("low"), F.col("length")).alias("values"))


def stretch_statistics(y: np.ndarray, a: int, n: int, least: int, boxes: int) -> list[tuple]:
    """(box, way, segment, mse, *PART) of a stretch of n values in all that begins at place a; y: its own running sum. Boxes are
    laid from both ends (way 0 and 1). Whole boxes add up in one row of way and segment -1, its part empty."""
    out, b = [], a + len(y)
    for box in box_sizes(n, least, boxes).tolist():
        t = np.arange(box) - (box - 1) / 2
        done = 0.0
        for way, skip in enumerate((0, n - n // box * box)):
            low, high = max(a, skip), min(b, skip + n // box * box)
            if low >= high:
                continue
            first, last = skip - (skip - low) // box * box, skip + (high - skip) // box * box
            if first < last:
                rows = y[first - a : last - a].reshape(-1, box)
                rows = rows - rows.mean(axis=1, keepdims=True)
                done += float(np.maximum((rows**2).sum(axis=1) - (rows @ t) ** 2 / (t @ t), 0).sum()) / box
            for x, z in ((low, min(first, high)), (max(last, first), high)):
                if x < z:
                    segment, v = (x - skip) // box, y[x - a : z - a]
                    place = np.arange(x, z) - skip - segment * box
                    out.append((box, way, segment, 0.0, float(z - x), place.mean(), v.mean(), float((place - place.mean()) @ (v - v.mean())), float(((v - v.mean()) ** 2).sum())))
        out.append((box, -1, -1, done, 0.0, 0.0, 0.0, 0.0, 0.0))
    return out


def fluctuations(df: DataFrame, returns: str, keys: Sequence[str], order: str, resamples: int, least: int, boxes: int, shortest: int = 0, size: int = ARRAY, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(keys, resample, box, f) of each series (resample -1) and of its resamples; (keys, n) of all series. Series of fewer than ``shortest`` values have none."""
    parts, sums = arrays(df, returns, keys, order, size)
    rows = slices(parts, sums.where(F.col("n") >= shortest), keys, resamples, size, stretch)
    columns = ["total", "box", "way", "segment", "mse", *PART]

    def found(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n, y = int(rows["n"].iloc[0]), np.cumsum(np.concatenate(rows["values"].to_list()) - rows["m"].iloc[0])
        found = [(None, *x) for x in stretch_statistics(y, int(rows["pos"].iloc[0]), n, least, boxes)]
        out = pd.DataFrame([(float(y[-1]), 0, -1, -1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), *found], columns=columns)
        for i, v in enumerate((*group, n)):
            out.insert(i, f"g{i}", v)
        return out

    group = [*keys, "resample", "stretch"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)
    schema = f"{types}, n bigint, total double, box bigint, way int, segment bigint, mse double, {', '.join(f'{c} double' for c in PART)}"
    each = spread(rows, *group).groupBy(*group).applyInPandas(lambda g, r: found(g, r).set_axis([*group, "n", *columns], axis=1), schema)
    before = Window.partitionBy(*keys, "resample").orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("my", F.col("my") + F.coalesce(F.sum("total").over(before), F.lit(0.0))).where("box > 0")
    c, t, y = F.col("c"), F.col("mt"), F.col("my")
    merged = each.groupBy(*keys, "resample", "n", "box", "way", "segment").agg(
        F.sum("mse").alias("mse"), F.sum(c).alias("c"), F.sum(c * t).alias("t"), F.sum(c * y).alias("y"), F.sum(c * y * y + F.col("syy")).alias("yy"), F.sum(c * t * y + F.col("sty")).alias("ty"),
    )
    box, c = F.col("box").cast("double"), F.col("c")
    rest = F.col("yy") - F.col("y") * F.col("y") / c - F.pow(F.col("ty") - F.col("t") * F.col("y") / c, F.lit(2.0)) / (box * (box * box - 1) / 12)
    mse = F.col("mse") + F.when(c > 0, F.greatest(rest, F.lit(0.0)) / box).otherwise(0.0)
    f = merged.groupBy(*keys, "resample", "n", "box").agg(F.sum(mse).alias("f")).withColumn("f", F.sqrt(F.col("f") / (2 * F.floor(F.col("n") / F.col("box")))))
    return f.select(*keys, "resample", "box", "f"), sums.select(*keys, "n")
