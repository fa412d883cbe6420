"""Rolling and whole-series statistics: scales, drawdowns, CDaR, moments, summaries, the overfitting gate."""
from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.frames import KEYS, ORDER, ordered, spread
from ..functions.prefix import running
from ..functions.scalars import normal_cdf
from .sliding import sliding_tail_means

YEAR, WEEK = 252, 5
#: Scales taken before enough rows are there, and how many are enough.
PRIOR_ABS, PRIOR_STD, ENOUGH = 0.008, 0.01, 20
EULER_FREE_95 = 1.645


def expanding_scales(df: DataFrame, returns: str = "log_return", keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """typical_abs (mean of the absolute) and scale (population standard deviation) of all returns so far."""
    r = F.col(returns)
    sums = {"__n": ("sum", F.when(r.isNotNull(), 1)), "__r": ("sum", r), "__rr": ("sum", r * r), "__abs": ("sum", F.abs(r))}
    n, mean = F.col("__n"), F.col("__r") / F.col("__n")
    variance = F.greatest(F.col("__rr") / n - mean * mean, F.lit(0.0))
    out = running(df, sums, keys, order).withColumn("typical_abs", F.when(n >= ENOUGH, F.col("__abs") / n).otherwise(PRIOR_ABS))
    return out.withColumn("scale", F.when(n >= ENOUGH, F.sqrt(variance)).otherwise(PRIOR_STD)).drop(*sums)


def drawdown(df: DataFrame, equity: str = "equity", keys: Sequence[str] = KEYS, out: str = "drawdown", order: str = ORDER) -> DataFrame:
    peak = F.col("__peak")
    return running(df, {"__peak": ("max", F.col(equity))}, keys, order).withColumn(out, (peak - F.col(equity)) / peak).drop("__peak")


def tail_mean(values: Column, alpha: float) -> Column:
    """Mean of the worst ceil(alpha n) of an array, at least one; 0 of an empty one."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    k = F.greatest(F.lit(1), F.ceil(F.round(alpha * F.size(values), 9)).cast("int"))
    worst = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.when(F.size(values) == 0, 0.0).otherwise(F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / k)


#: Rows of a stretch of a series that a task takes.
STRETCH = 4096


def trailing_cdar(df: DataFrame, alpha: float = 0.05, window: int = 252, equity: str = "equity", keys: Sequence[str] = KEYS, out: str = "cdar") -> DataFrame:
    """Peaks come from the whole history, the tail from the last rows of the window.

    Drawdowns under carried peaks go in stretches of STRETCH rows, with the window's rows before them, to a tree of ranks that gives
    the mean of the worst in a logarithm of the stretch; only (keys, bar, mean) comes back.
    """
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    if window < 1:
        raise ValueError(f"window must be at least 1, got {window}")
    rows = running(drawdown(df.select(*keys, ORDER, equity), equity, keys, "__dd"), {"__n": ("sum", F.lit(1))}, keys, ORDER)
    place = F.col("__n") - 1
    rows = rows.select(*keys, F.col(ORDER).alias("__i"), place.alias("__n"), F.col("__dd").cast("double").alias("__dd"), F.explode(F.sequence(F.floor(place / STRETCH), F.floor((place + window - 1) / STRETCH))).alias("__s"))
    schema = StructType([*(rows.schema[k] for k in keys), rows.schema["__i"], StructField(out, DoubleType())])

    def tails(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__n")
        means = sliding_tail_means(part["__dd"].to_numpy(np.float64), window, alpha)
        own = (part["__n"] // STRETCH == part["__s"]).to_numpy()
        return pd.DataFrame({**{k: part[k][own] for k in keys}, "__i": part["__i"][own], out: means[own]})

    found = spread(rows, *keys, "__s").groupBy(*keys, "__s").applyInPandas(tails, schema).withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = F.col(ORDER) == F.col("__i")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return df.join(found, same, "left").drop("__i", *(f"__key_{k}" for k in keys))


def sharpe(returns: Column, per_year: int = 1) -> Column:
    """Mean over sample deviation, annualised by rows a year; 0 without a deviation."""
    sd = F.stddev_samp(returns)
    return F.coalesce(F.when(sd > 0, F.avg(returns) / F.when(sd > 0, sd) * math.sqrt(per_year)), F.lit(0.0))


def summary(df: DataFrame, by: Sequence[str], net: str = "net_return", trade: str = "is_trade") -> DataFrame:
    """bars, trades, trades_per_week, sharpe of each group."""
    trades = F.sum(F.col(trade).cast("int"))
    return df.groupBy(*by).agg(F.count("*").alias("bars"), trades.alias("trades"), (trades / F.count("*") * WEEK).alias("trades_per_week"), sharpe(F.col(net), YEAR).alias("sharpe"))


def central(x: Column, order: int) -> Column:
    """A central moment from raw moments, in one aggregation."""
    m = [F.avg(F.pow(x, F.lit(float(k)))) for k in range(order + 1)]
    return sum((F.lit(float(math.comb(order, k) * (-1) ** (order - k))) * m[k] * F.pow(m[1], F.lit(float(order - k))) for k in range(order + 1)), F.lit(0.0))


def moments(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """n, mean, std (sample), skew and kurtosis_excess (biased), jb and jb_p (two degrees of freedom)."""
    c, n = F.col(x), F.count(x)
    out = df.groupBy(*by).agg(n.alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis_excess"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurtosis_excess") * F.col("kurtosis_excess") / 4)
    return out.withColumn("jb", jb).withColumn("jb_p", F.exp(-F.col("jb") / 2))


def quantile_pairs(df: DataFrame, x: str, by: Sequence[str] = KEYS) -> DataFrame:
    """p, value, normal: what a quantile-quantile plot shows."""
    grid = [i / 20 for i in range(1, 20)]
    normal = {p: NormalDist().inv_cdf(p) for p in grid}
    found = df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, grid))).alias("q"))
    table = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(z).alias("normal")) for p, z in normal.items()))
    return found.select(*by, F.explode(F.arrays_zip(table.alias("t"), F.col("q"))).alias("z")).select(*by, F.col("z.t.p").alias("p"), F.col("z.q").alias("value"), F.col("z.t.normal").alias("normal"))


def expected_best(n_trials: Column) -> Column:
    """Expected largest of so many standard normal Sharpe ratios, by extreme values; 0 for one trial."""
    root = F.sqrt(2 * F.log(n_trials))
    return F.when(n_trials <= 1, 0.0).otherwise(root - (F.log(F.when(n_trials > 1, F.log(n_trials))) + math.log(4 * math.pi)) / (2 * root))


def deflated_sharpe(sr: Column, n_trials: Column, n: Column, skew: Column, kurt: Column) -> dict[str, Column]:
    """dsr (a z score), p_value and min_length of a per-period Sharpe ratio that was the best of many; kurt is raw."""
    v = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    best = expected_best(n_trials)
    z = (sr - best * F.sqrt(1 / (n - 1))) / F.sqrt(v / (n - 1))
    length = F.when(sr > 0, F.ceil(F.pow((best + EULER_FREE_95 * F.sqrt(v)) / sr, 2)))
    return {"dsr": z, "p_value": 1 - normal_cdf(z), "min_length": length}


def overfitting_gate(trials: DataFrame, trial_id: str, returns: DataFrame, net: str = "net_return") -> DataFrame:
    """The gate of one logged trial over its held-out returns: every logged trial counts. An unknown trial raises."""
    if not trials.where(F.col("trial_id") == trial_id).limit(1).count():
        raise ValueError(f"unknown trial_id {trial_id!r}")
    count = trials.agg(F.count("*").alias("num_trials"))
    r = F.col(net)
    held = returns.agg(sharpe(r).alias("sr"), F.count(r).alias("num_obs"), F.skewness(r).alias("skewness"), (F.kurtosis(r) + 3).alias("kurtosis_raw")).crossJoin(count)
    out = deflated_sharpe(F.col("sr"), F.col("num_trials"), F.col("num_obs"), F.col("skewness"), F.col("kurtosis_raw"))
    return held.select(F.lit(trial_id).alias("trial_id"), F.col("sr").alias("observed_sr_per_period"), "num_trials", "num_obs", "skewness", "kurtosis_raw", *(c.alias(k) for k, c in out.items()))


def best_row(df: DataFrame, by: Sequence[str], score: str, position: str) -> DataFrame:
    """The row of the largest score of each group, the first by position among equals."""
    row = F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(position)))
    picked = df.groupBy(*by).agg(row.alias("r")) if by else df.agg(row.alias("r"))
    return picked.select("r.*")


def lag_one_autocorrelation(df: DataFrame, x: str, by: Sequence[str] = KEYS) -> DataFrame:
    pairs = df.withColumn("__before", F.lag(x).over(ordered(by)))
    a, b = F.col(x), F.col("__before")
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    cov = F.avg(a * b * both) - F.avg(a * both) * F.avg(b * both)
    return pairs.groupBy(*by).agg(F.try_divide(cov, F.sqrt(F.var_pop(a * both) * F.var_pop(b * both))).alias("autocorrelation"))
