"""Detrended fluctuation analysis: of windows as relations (boxes are exploded, segments are regressions), of whole series and their resamples in stretches."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, spread
from . import stretched

LEAST_BOX, BOXES, WINDOW, RESAMPLES, CONFIDENCE = 10, 15, 252, 200, 0.95


def profile(df: DataFrame, returns: str, keys: Sequence[str], order: str = ORDER) -> DataFrame:
    """keys, i (from 0), n, y: the running sum of returns less their mean; null returns do not count. For windows: a task has all rows of a key."""
    rows = df.where(F.col(returns).isNotNull())
    every, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, order, F.col(returns).alias("r"), F.count("*").over(every).alias("n"), F.avg(returns).over(every).alias("m"))
    return rows.select(*keys, (F.row_number().over(by) - 1).alias("i"), "n", F.sum(F.col("r") - F.col("m")).over(upto).alias("y"))


def fluctuations(prof: DataFrame, keys: Sequence[str], least: int = LEAST_BOX, boxes: int = BOXES) -> DataFrame:
    """keys, box, f: root mean square distance from linear trends in boxes laid from both ends. Partial sums meet before the shuffle."""
    low, high = math.log10(least), F.log10(F.floor(F.col("n") / 4))
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(boxes - 1)), lambda k: F.rint(F.pow(F.lit(10.0), low + (high - low) * k / (boxes - 1))).cast("int")))
    rows = prof.withColumn("box", F.explode(F.filter(sizes, lambda b: b >= 4))).withColumn("segments", F.floor(F.col("n") / F.col("box"))).where("segments >= 2")
    rows = rows.select("*", F.posexplode(F.array(F.lit(0).cast("bigint"), (F.col("n") - F.col("segments") * F.col("box")).cast("bigint"))).alias("way", "skip"))
    rows = rows.withColumn("at", F.col("i") - F.col("skip")).where("at >= 0 and at < segments * box")
    t = (F.col("at") % F.col("box")).cast("double")
    parts = rows.withColumn("t", t).groupBy(*keys, "box", "way", F.floor(F.col("at") / F.col("box")).alias("segment"))
    mse = parts.agg(((F.regr_syy("y", "t") - F.pow(F.regr_sxy("y", "t"), F.lit(2.0)) / F.regr_sxx("y", "t")) / F.count("*")).alias("mse"))
    return mse.groupBy(*keys, "box").agg(F.sqrt(F.avg("mse")).alias("f"))


def exponent(f: DataFrame, keys: Sequence[str]) -> DataFrame:
    x, y = F.log10(F.col("box").cast("double")), F.log10(F.when(F.col("f") > 0, F.col("f")))
    return f.where("f > 0").groupBy(*keys).agg(F.regr_slope(y, x).alias("hurst"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("boxes"))


def dfa(df: DataFrame, returns: str = "log_return", keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """keys, hurst, intercept, boxes of whole series, each in stretches."""
    return exponent(stretched.fluctuations(df, returns, keys, order, 0, LEAST_BOX, BOXES)[0], keys)


def windows_of(df: DataFrame, returns: str, window: int, step: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every ``step``-th trailing window as rows of its own: keys, end_bar, bar_idx, r. Each row is copied into window / step windows."""
    rows = df.where(F.col(returns).isNotNull())
    first = rows.groupBy(*keys).agg(F.min(ORDER).alias("__first"), F.max(ORDER).alias("__last"))
    ends = F.sequence(F.col(ORDER) + F.pmod(F.col("__first") + window - 1 - F.col(ORDER), F.lit(step)), F.least(F.col(ORDER) + window - 1, F.col("__last")), F.lit(step).cast("bigint"))
    start = F.col(ORDER) + F.pmod(F.col("__first") + window - 1 - F.col(ORDER), F.lit(step))
    met = rows.join(first, list(keys)).withColumn("end_bar", F.explode(F.when(start <= F.least(F.col(ORDER) + window - 1, F.col("__last")), ends)))
    return met.where(F.col("end_bar") >= F.col("__first") + window - 1).select(*keys, "end_bar", ORDER, F.col(returns).alias("r"))


def rolling_dfa(df: DataFrame, returns: str = "log_return", window: int = WINDOW, step: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, end_bar, hurst of every ``step``-th full window."""
    own = [*keys, "end_bar"]
    return exponent(fluctuations(profile(windows_of(df, returns, window, step, keys), "r", own), own), own).select(*own, "hurst")


def rolling_exponent(df: DataFrame, returns: str = "log_return", window: int = WINDOW, keys: Sequence[str] = KEYS) -> DataFrame:
    """rolling_dfa of every full window, each one array to numpy: as many rows as bars. A window of one value has no exponent."""
    rows = df.where(F.col(returns).isNotNull())
    by = Window.partitionBy(*keys).orderBy(ORDER)
    rows = rows.select(*keys, F.col(ORDER).alias("end_bar"), F.collect_list(returns).over(by.rangeBetween(-(window - 1), 0)).alias("w"), F.min(ORDER).over(Window.partitionBy(*keys)).alias("first"))

    @F.pandas_udf("double")
    def found(windows: pd.Series) -> pd.Series:
        return pd.Series([float(dfa_many(np.asarray(w, np.float64)[None])[0]) for w in windows], dtype="float64")

    rows = rows.where((F.col("end_bar") >= F.col("first") + window - 1) & (F.array_min("w") < F.array_max("w")))
    return spread(rows, *keys, "end_bar").select(*keys, "end_bar", found("w").alias("hurst"))


def block_size(n: int) -> int:
    return min(n, max(10, round(2 * n ** (1 / 3))))


def dfa_many(rows: np.ndarray, least: int = LEAST_BOX, boxes: int = BOXES) -> np.ndarray:
    """Exponents of many series of one length at once (one a row)."""
    n = rows.shape[1]
    y = np.cumsum(rows - rows.mean(axis=1, keepdims=True), axis=1)
    logs, f = [], []
    for b in stretched.box_sizes(n, least, boxes):
        k, t = n // b, np.arange(b) - (b - 1) / 2
        both = np.concatenate([y[:, : k * b].reshape(len(y), k, b), y[:, n - k * b :].reshape(len(y), k, b)], axis=1)
        both = both - both.mean(axis=2, keepdims=True)
        rest = (both**2).sum(axis=2) - (both @ t) ** 2 / (t @ t)
        logs.append(np.log10(b))
        f.append(np.sqrt(np.maximum(rest, 0).mean(axis=1) / b))
    x, z = np.array(logs) - np.mean(logs), np.log10(np.maximum(np.array(f), 1e-300))
    return x @ z / (x @ x)


def pieced_series(values: np.ndarray, resample: int) -> np.ndarray:
    """A series of the same length from blocks of the whole one. Starts are hashes of (resample, place), so that SQL can draw them as well."""
    n = len(values)
    block = block_size(n)
    starts = np.array([int(hashlib.md5(f"{resample}:{k}".encode()).hexdigest()[:8], 16) % (n - block + 1) for k in range(-(-n // block))])
    return values[(starts[:, None] + np.arange(block)).reshape(-1)[:n]]


def series_interval(df: DataFrame, returns: str = "log_return", resamples: int = RESAMPLES, keys: Sequence[str] = KEYS, order: str = ORDER, confidence: float = CONFIDENCE, least: int = 40) -> DataFrame:
    """keys, hurst, ci_low, ci_high, resamples: the exponent of each whole series and the percentile interval of its block bootstrap.

    Null returns do not count; a series shorter than ``least`` has nulls and 0 resamples, and a constant one has no exponent.
    Tasks work on stretches of a series or of a resample (``stretched``), so one series spreads over the cluster.
    """
    f, series = stretched.fluctuations(df, returns, keys, order, resamples, LEAST_BOX, BOXES, least)
    each = exponent(f, [*keys, "resample"]).unionByName(series.select(*keys), allowMissingColumns=True)
    own, drawn = F.when(F.col("resample") < 0, F.col("hurst")), F.when(F.col("resample") >= 0, F.col("hurst"))
    tail = (1 - confidence) / 2
    return each.groupBy(*keys).agg(F.max(own).alias("hurst"), F.percentile(drawn, F.lit(tail)).alias("ci_low"), F.percentile(drawn, F.lit(1 - tail)).alias("ci_high"), F.count(drawn).alias("resamples"))


def window_multiplier(values: np.ndarray, resamples: int, seed: int) -> tuple[float, float, float]:
    """Exponent of a window, and the percentile interval of its block bootstrap."""
    n = len(values)
    block = block_size(n)
    starts = np.random.default_rng(seed).integers(0, n - block + 1, size=(resamples, -(-n // block)))
    pieced = values[(starts[:, :, None] + np.arange(block)).reshape(resamples, -1)[:, :n]]
    low, high = np.percentile(dfa_many(pieced), [100 * (1 - CONFIDENCE) / 2, 100 * (1 + CONFIDENCE) / 2])
    return float(dfa_many(values[None])[0]), float(low), float(high)


def with_interval(df: DataFrame, window: str, resamples: int = 50, seed: int = 0, least: int = 40) -> DataFrame:
    """hurst, ci_low, ci_high of a column of windows (arrays); null where a window is shorter than ``least``.

    For many short windows with many resamples each: a few hundred numbers go to numpy instead of a few million rows to a shuffle.
    """
    @F.pandas_udf("struct<hurst double, ci_low double, ci_high double>")
    def found(windows: pd.Series) -> pd.DataFrame:
        out = [window_multiplier(np.asarray(w, np.float64), resamples, seed) if len(w) >= least else (None, None, None) for w in windows]
        return pd.DataFrame(out, columns=["hurst", "ci_low", "ci_high"], dtype="float64")

    df = df.withColumn("__h", found(F.col(window)))
    return df.withColumns({c: F.when(~F.isnan(f"__h.{c}"), F.col(f"__h.{c}")) for c in ("hurst", "ci_low", "ci_high")}).drop("__h")
