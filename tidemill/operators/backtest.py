"""Sized backtests: position size depends on the drawdowns that earlier positions caused, so each (series, setting) is one
recursion; settings and series run in parallel."""
from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, ordered, spread
from ..functions.prefix import running
from .stats import YEAR, sharpe

ALPHA, WINDOW, COST, TRAIN = 0.05, 252, 0.0002, 0.6
#: The settings tried by default, and the feasible trade rate.
BANDS = tuple(round(0.02 * k, 2) for k in range(26))
LIMITS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 1.0)
LEAST_TRADES, MOST_TRADES = 1.0, 5.0


class Tail:
    """Mean of the worst share of the last drawdowns of an equity path."""

    def __init__(self, alpha: float, window: int) -> None:
        if not 0 < alpha <= 1:
            raise ValueError(f"alpha must be in (0, 1], got {alpha}")
        if window < 1:
            raise ValueError(f"window must be at least 1, got {window}")
        self.alpha, self.window, self.peak, self.last, self.sorted = alpha, window, -math.inf, deque(), []

    def add(self, equity: float) -> float:
        self.peak = max(self.peak, equity)
        d = (self.peak - equity) / self.peak
        self.last.append(d)
        insort(self.sorted, d)
        if len(self.last) > self.window:
            self.sorted.pop(bisect_left(self.sorted, self.last.popleft()))
        k = max(1, math.ceil(round(self.alpha * len(self.sorted), 9)))
        return sum(self.sorted[-k:]) / k


def sized_path(scores: np.ndarray, agreement: np.ndarray, returns: np.ndarray, bands: np.ndarray, limit: float, alpha: float = ALPHA, window: int = WINDOW, cost: float = COST) -> dict[str, np.ndarray]:
    """position, net, trade, equity (after each row) of one path. agreement: share of votes with the score's sign."""
    if limit <= 0:
        raise ValueError(f"the CDaR limit must be positive, got {limit}")
    if ((bands < 0) | (bands >= 1)).any():
        raise ValueError("the neutral band must be in [0, 1)")
    if not np.isfinite(scores).all():
        raise ValueError("scores must be finite")
    sign, size = np.sign(scores), np.where(np.abs(scores) <= bands, 0.0, (np.abs(scores) - bands) / (1 - bands)) * agreement
    raw = (sign * size).tolist()
    tail, equity, before = Tail(alpha, window), 1.0, 0.0
    cdar = tail.add(equity)
    position, net, trade, path = (np.zeros(len(raw)) for _ in range(4))
    for t, (want, r) in enumerate(zip(raw, returns.tolist())):
        p = want * min(1.0, max(0.0, 1 - cdar / limit))
        net[t] = p * r - cost * abs(p - before)
        equity *= 1 + net[t]
        position[t], path[t], trade[t] = p, equity, np.sign(p) != np.sign(before)
        cdar, before = tail.add(equity), p
    return {"position": position, "net_return": net, "is_trade": trade.astype(bool), "equity": path}


def agreement_of(score: Column, votes: Sequence[Column]) -> Column:
    return sum((F.when(F.signum(v) == F.signum(score), 1.0).otherwise(0.0) for v in votes), F.lit(0.0)) / len(votes)


def sized_backtest(df: DataFrame, settings: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, band: str | None = None) -> DataFrame:
    """Every series under every setting, or under its own where df has a setting column. df: keys, order, score, agreement, next_return[, a band column]; settings (a small table): setting, band, cdar_limit, alpha, window, cost.

    Rows: keys, setting, order, position, net_return, is_trade, equity.
    """
    names = [*keys, "setting"]
    rows = df.select(*keys, *(["setting"] if "setting" in df.columns else []), F.col(order).alias("__i"), "score", "agreement", "next_return", *([F.col(band).alias("__band")] if band else []))
    table = F.broadcast(settings.select("setting", F.col("band").alias("__own_band"), "cdar_limit", "alpha", "window", "cost"))
    rows = rows.join(table, "setting") if "setting" in df.columns else rows.crossJoin(table)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, s = part.sort_values("__i"), part.iloc[0]
        bands = part["__band" if band else "__own_band"].to_numpy(np.float64)
        path = sized_path(*(part[c].to_numpy(np.float64) for c in ("score", "agreement", "next_return")), bands, float(s["cdar_limit"]), float(s["alpha"]), int(s["window"]), float(s["cost"]))
        return pd.DataFrame({**dict(zip(names, ([v] * len(part) for v in key))), order: part["__i"].to_numpy(), **path})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return spread(rows, *names).groupBy(*names).applyInPandas(one, f"{kinds}, {order} long, position double, net_return double, is_trade boolean, equity double")


def fixed_backtest(df: DataFrame, position: str, next_return: str, cost: float = COST, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions that are given: turnover, net_return, is_trade, equity as windows, all in the JVM."""
    before = F.lag(position, 1, 0.0).over(ordered(keys))
    df = df.withColumn("turnover", F.abs(F.col(position) - before)).withColumn("is_trade", F.signum(position) != F.signum(before))
    df = df.withColumn("net_return", F.col(position) * F.col(next_return) - cost * F.col("turnover"))
    return running(df, {"__log": ("sum", F.log1p("net_return"))}, keys, ORDER).withColumn("equity", F.exp("__log")).drop("__log")


def split_at(n: Column, share: float = TRAIN) -> Column:
    """Rows of the training part, half to even."""
    if not 0 < share < 1:
        raise ValueError(f"the training share must be in (0, 1), got {share}")
    return F.rint(n * share).cast("bigint")


def halves(path: DataFrame, by: Sequence[str], order: str = ORDER, share: float = TRAIN) -> DataFrame:
    """Adds k (row from 0), n, split and half ('train' or 'heldout')."""
    w = Window.partitionBy(*by)
    df = path.withColumn("k", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w)).withColumn("split", split_at(F.col("n"), share))
    return df.withColumn("half", F.when(F.col("k") < F.col("split"), "train").otherwise("heldout"))


def metrics(path: DataFrame, by: Sequence[str], order: str = ORDER, share: float = TRAIN) -> DataFrame:
    """One row per trial: Sharpe ratios and trade rates of both parts, held-out moments and total return, maximal drawdown."""
    df = halves(path, by, order, share)
    peak = F.greatest(F.lit(1.0), F.max("equity").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__dd", (peak - F.col("equity")) / peak)
    pick = {h: F.when(F.col("half") == h, F.col("net_return")) for h in ("train", "heldout")}
    rate = lambda h: F.sum(F.when(F.col("half") == h, F.col("is_trade").cast("int"))) / F.count(pick[h]) * 5
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_decisions"), F.max("split").alias("split_index"),
        *(x for h in ("train", "heldout") for x in (sharpe(pick[h]).alias(f"{h}_sharpe_pp"), sharpe(pick[h], YEAR).alias(f"{h}_sharpe_ann"), rate(h).alias(f"{h}_trades_per_week"))),
        F.skewness(pick["heldout"]).alias("heldout_skew"), (F.kurtosis(pick["heldout"]) + 3).alias("heldout_kurt_raw"),
        (F.product(1 + pick["heldout"]) - 1).alias("heldout_total_return"), F.max("__dd").alias("max_drawdown"),
    )
    return out


def settings_table(spark, bands: Sequence[float] = BANDS, limits: Sequence[float] = LIMITS, alpha: float = ALPHA, window: int = WINDOW, cost: float = COST) -> DataFrame:
    rows = [(i, float(b), float(c), alpha, window, cost) for i, (b, c) in enumerate((b, c) for b in bands for c in limits)]
    return spark.createDataFrame(rows, "setting int, band double, cdar_limit double, alpha double, window int, cost double")


def sweep(df: DataFrame, settings: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """keys, setting, band, cdar_limit and both parts' Sharpe and trade rate."""
    m = metrics(sized_backtest(df, settings, keys, order), [*keys, "setting"], order)
    keep = ["train_sharpe_ann", "train_trades_per_week", "heldout_sharpe_ann", "heldout_trades_per_week"]
    return m.join(F.broadcast(settings.select("setting", "band", "cdar_limit")), "setting").select(*keys, "setting", "band", "cdar_limit", *keep)


def select_setting(rows: DataFrame, keys: Sequence[str] = KEYS, least: float = LEAST_TRADES, most: float = MOST_TRADES) -> DataFrame:
    """The feasible setting of the largest training Sharpe ratio, the first among equals; series without one raise."""
    ok = F.col("train_trades_per_week").between(least, most)
    cols = [c for c in rows.columns if c not in keys]
    best = F.max(F.when(ok, F.struct("train_sharpe_ann", (-F.col("setting")).alias("o"), F.struct(*cols).alias("row"))))
    found = rows.groupBy(*keys).agg(best.alias("b"))
    none = F.raise_error(F.lit("no setting has a training trade rate inside the target"))
    return found.where(F.when(F.col("b").isNull(), none.cast("boolean")).otherwise(True)).select(*keys, "b.row.*")
