"""Mean reversion: Ornstein-Uhlenbeck fits on trailing windows, and the regime-switched sub-signal."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ordered, trailing

OU_WINDOW, TREND_WINDOW, TREND_BANDWIDTH, TREND_LOOKBACK = 100, 150, 20, 10


def ou_fit(df: DataFrame, price: str = "close", window: int = OU_WINDOW, keys: Sequence[str] = KEYS, least: int = 3) -> DataFrame:
    """theta, mu, half_life, resid_std of the regression of changes on levels over the last ``window`` prices.

    mu and half_life are null unless theta is positive; all are null before ``least`` prices. The residual deviation comes from
    the variance of the changes and the squared correlation, so one frame gives everything.
    """
    if window < 3 or least < 3:
        raise ValueError("a fit needs at least 3 prices")
    level = F.lag(price).over(ordered(keys))
    df = df.withColumn("__x", level).withColumn("__d", F.col(price) - level)
    w = trailing(window - 1, keys)
    ready = F.count("__d").over(w) >= least - 1
    x, d = F.when(F.col("__d").isNotNull(), F.col("__x")), F.col("__d")
    slope, intercept = F.regr_slope(d, x).over(w), F.regr_intercept(d, x).over(w)
    sxx, syy, sxy = F.regr_sxx(d, x).over(w), F.regr_syy(d, x).over(w), F.regr_sxy(d, x).over(w)
    rest = F.greatest(F.lit(0.0), syy - F.when(sxx > 0, sxy * sxy / F.when(sxx > 0, sxx)).otherwise(0.0))
    df = df.withColumns({"__b": F.when(ready, slope), "__a": F.when(ready, intercept), "resid_std": F.when(ready, F.sqrt(rest / F.count("__d").over(w)))})
    back = F.col("__b") < 0
    return df.withColumn("theta", -F.col("__b")).withColumn("mu", F.when(back, -F.col("__a") / F.col("__b"))).withColumn("half_life", F.when(back, math.log(2) / -F.col("__b"))).drop("__x", "__d", "__a", "__b")


def trend_slope(prices: np.ndarray, bandwidth: float = TREND_BANDWIDTH, lookback: int = TREND_LOOKBACK) -> float:
    """Slope of the last stretch of a two-sided kernel curve, in deviations of the curve's steps; 0 for a flat curve."""
    n = len(prices)
    k = np.exp(-0.5 * ((np.arange(n)[:, None] - np.arange(n)) / bandwidth) ** 2)
    curve = k @ prices / k.sum(axis=1)
    tail = curve[-min(lookback, n) :]
    t = np.arange(len(tail)) - (len(tail) - 1) / 2
    vol = np.std(np.diff(curve)) if n > 1 else 0.0
    return float(t @ tail / (t @ t) / vol) if vol > 0 and len(tail) > 1 else 0.0


def with_trend_slope(df: DataFrame, price: str = "close", window: int = TREND_WINDOW, keys: Sequence[str] = KEYS, out: str = "trend_slope") -> DataFrame:
    @F.pandas_udf("double")
    def slopes(windows: pd.Series) -> pd.Series:
        # The curve is linear in the prices: full windows share one matrix product.
        result = np.zeros(len(windows))
        lengths = windows.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            y = np.stack([np.asarray(windows.iloc[i], np.float64) for i in at], axis=1)
            k = np.exp(-0.5 * ((np.arange(n)[:, None] - np.arange(n)) / TREND_BANDWIDTH) ** 2)
            curve = (k / k.sum(axis=1, keepdims=True)) @ y
            tail = curve[-min(TREND_LOOKBACK, n) :]
            if n < 2 or len(tail) < 2:
                continue
            t = np.arange(len(tail)) - (len(tail) - 1) / 2
            vol = np.diff(curve, axis=0).std(axis=0)
            result[at] = np.divide(t @ tail / (t @ t), vol, out=np.zeros(len(at)), where=vol > 0)
        return pd.Series(result)

    return df.withColumn(out, slopes(F.collect_list(price).over(trailing(window, keys))))


def reversion_signal(price: Column, scale: float = 2.0) -> Column:
    """From the columns of ou_fit; 0 without a fit or a deviation."""
    spread = F.col("resid_std") / F.sqrt(2 * F.col("theta"))
    return F.when(F.col("half_life").isNull() | (F.col("resid_std") == 0), 0.0).otherwise(F.tanh((F.col("mu") - price) / spread / scale))


def subsignal(label: Column, price: Column, trend: Column = None, scale: float = 2.0) -> Column:
    """Trend in bull and bear, reversion in sideways; other labels raise."""
    trend = F.col("trend_slope") if trend is None else trend
    return F.when(label.isNull(), None).when(label.isin("bull", "bear"), F.tanh(trend / scale)).when(label == "sideways", reversion_signal(price, scale)).otherwise(F.raise_error(F.concat(F.lit("unknown regime label: "), label)).cast("double"))
