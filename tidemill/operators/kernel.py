"""Kernel regression over unit-spaced bars. Nine bandwidths away a weight is below the last bit of the largest, so every
estimate is a sum over a bounded frame of rows: no pair of distant bars is ever formed."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.frames import KEYS, ORDER, spread, trailing, whole
from ..functions.prefix import numbered

REACH = 9
STRETCH = 4096
#: The bandwidths tried.
BANDWIDTHS = (2, 3, 5, 8, 12, 18, 27, 40, 60, 90, 135)


def weights(bandwidth: float) -> list[float]:
    """By lag from 0."""
    return [math.exp(-0.5 * (k / bandwidth) ** 2) / math.sqrt(2 * math.pi) for k in range(math.ceil(REACH * bandwidth) + 1)]


def _in_stretches(df: DataFrame, reach: int, ahead: bool, keys: Sequence[str]) -> DataFrame:
    """Rows with their number __i in the series, in every stretch __s of STRETCH rows that lies within reach of them."""
    rows = numbered(df, ORDER, keys, None, "__i")
    first = F.greatest(F.lit(0), F.col("__i") - reach) if ahead else F.col("__i")
    return rows.withColumn("__s", F.explode(F.sequence(F.floor(first / STRETCH), F.floor((F.col("__i") + reach) / STRETCH))))


def smoothed(y: np.ndarray, w: np.ndarray, ahead: bool) -> np.ndarray:
    """Weighted means of the rows up to each one, or of those on both sides; w: by lag from 0. rows without a value (null or NaN) are left
    out and those beyond them move up, within a frame of as many rows as there are weights."""
    none = np.isnan(y)
    if not none.any():
        around = np.concatenate([w[:0:-1], w]) if ahead else w
        at = len(w) - 1 if ahead else 0
        top, low = (np.convolve(x, around)[at : at + len(y)] for x in (y, np.ones(len(y))))
        return top / low
    out = np.full(len(y), np.nan)
    for i in range(len(y)):
        sides = [y[max(0, i + 1 - len(w)) : i + 1][::-1]]
        if ahead:
            sides = [sides[0][1:], y[i + 1 : i + len(w)]]
        sides = [x[~np.isnan(x)] for x in sides]
        if ahead and none[i]:
            continue
        top, low = (w[0] * y[i], w[0]) if ahead else (0.0, 0.0)
        for x in sides:
            own = w[int(ahead) : int(ahead) + len(x)]
            top, low = top + x @ own, low + own.sum()
        out[i] = top / low if low else np.nan
    return out


def _estimate(df: DataFrame, bandwidth: float, value: str, keys: Sequence[str], out: str, ahead: bool) -> DataFrame:
    """Stretches with the rows within reach go to numpy as Arrow tables; the other columns pass through untouched."""
    w = np.array(weights(bandwidth))
    rest = [c for c in df.columns if c != out]
    schema = StructType([*(df.schema[c] for c in rest), StructField(out, DoubleType())])
    rows = _in_stretches(df.withColumn("__y", F.col(value).cast("double")), len(w) - 1, ahead, keys)

    def found(part: pa.Table) -> pa.Table:
        part = part.sort_by("__i")
        own = pc.equal(pc.floor(pc.divide(pc.cast(part["__i"], pa.float64()), float(STRETCH))), pc.cast(part["__s"], pa.float64()))
        x = smoothed(part["__y"].to_numpy(), w, ahead)
        return part.select(rest).append_column(out, pa.array(x, from_pandas=True)).filter(own)

    return spread(rows.select(*rest, "__y", "__i", "__s"), *keys, "__s").groupBy(*keys, "__s").applyInArrow(found, schema)


def causal_estimate(df: DataFrame, bandwidth: float, value: str = "close", keys: Sequence[str] = KEYS, out: str = "estimate") -> DataFrame:
    """Of a row and those before it; null before the first value."""
    return _estimate(df, bandwidth, value, keys, out, False)


def causal_deviation(df: DataFrame, bandwidth: float, value: str = "close", keys: Sequence[str] = KEYS, window: int = 252, least: int = 20, out: str = "deviation") -> DataFrame:
    """Residual of the one-sided estimate over its trailing sample deviation; null before enough rows."""
    df = causal_estimate(df, bandwidth, value, keys, "__estimate").withColumn("__residual", F.col(value) - F.col("__estimate"))
    w = trailing(window, keys)
    sd = F.when(F.count("__residual").over(w) >= least, F.stddev_samp("__residual").over(w))
    return df.withColumn("__sd", sd).withColumn(out, F.when(F.col("__sd") > 0, F.col("__residual") / F.col("__sd"))).drop("__estimate", "__residual", "__sd")


def two_sided_estimate(df: DataFrame, bandwidth: float, value: str = "close", keys: Sequence[str] = KEYS, out: str = "estimate") -> DataFrame:
    """Of the rows on both sides and the row itself; null for a row without a value."""
    return _estimate(df, bandwidth, value, keys, out, True)


def two_sided_deviation(df: DataFrame, estimate: str = "estimate", value: str = "close", keys: Sequence[str] = KEYS, out: str = "signal") -> DataFrame:
    """Residual over its population deviation in the whole series; zeros without a deviation."""
    r = F.col(value) - F.col(estimate)
    sd = F.stddev_pop(r).over(whole(keys))
    return df.withColumn(out, F.when(sd > 0, r / F.when(sd > 0, sd)).otherwise(0.0))


def loocv(df: DataFrame, bandwidths: Sequence[float] = BANDWIDTHS, value: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """Leave-one-out error of every bandwidth: keys, bandwidth, mse. Rows without a value do not count.

    Stretches of STRETCH rows, with as many neighbours as the widest kernel reaches, go to numpy once for all bandwidths: a long
    series is many groups, and only sums of errors meet again. A row with no weight around it has no error; null without any.
    """
    reach = math.ceil(REACH * max(bandwidths))
    rows = _in_stretches(df.where(F.col(value).isNotNull()).select(*keys, ORDER, F.col(value).cast("double").alias("__y")), reach, True, keys).drop(ORDER)
    schema = StructType([*(rows.schema[k] for k in keys), StructField("bandwidth", DoubleType()), StructField("e", DoubleType()), StructField("n", LongType())])

    def errors(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__i")
        y, own = part["__y"].to_numpy(), (part["__i"] // STRETCH == part["__s"]).to_numpy()
        out = []
        for h in bandwidths if own.any() else ():
            w = np.array(weights(h))
            around = np.concatenate([w[:0:-1], [0.0], w[1:]])
            top, low = (np.convolve(x, around)[len(w) - 1 : len(w) - 1 + len(y)][own] for x in (y, np.ones(len(y))))
            some = low > 1e-300
            miss = y[own][some] - top[some] / low[some]
            out.append([*(part[k].iloc[0] for k in keys), float(h), float(miss @ miss), int(some.sum())])
        return pd.DataFrame(out, columns=schema.names)

    # dealt as bounded groups: adaptive execution would give them all to one task
    found = spread(rows, *keys, "__s").groupBy(*keys, "__s").applyInPandas(errors, schema)
    return found.groupBy(*keys, "bandwidth").agg((F.sum("e") / F.when(F.sum("n") > 0, F.sum("n"))).alias("mse"))


def best_bandwidth(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, bandwidth, mse: the smallest error, the smallest bandwidth among equals."""
    return scores.groupBy(*keys).agg(F.min(F.struct("mse", "bandwidth")).alias("b")).select(*keys, F.col("b.bandwidth").alias("bandwidth"), F.col("b.mse").alias("mse"))

