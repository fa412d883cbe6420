"""The weighted consensus of votes, and weights that follow each vote's recent hit rate."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER
from ..functions.scalars import NEUTRAL_BAND, band_label, gex_regime, kernel_vote, regime_vote, sign, subsignal_vote, tanh_vote

VOTES = ("regime", "order_flow", "kernel")
WINDOW, FLOOR, CHANCE, LEAST, EVERY = 100, 0.01, 0.5, 20, 20


def votes_of(regime: Column, order_flow: Column, deviation: Column, regime_mode: str = "label", subsignal: Column | None = None, reading: str = "mean_reversion", wss: Column | None = None) -> dict[str, Column]:
    if regime_mode not in ("label", "subsignal"):
        raise ValueError(f"unknown regime_mode {regime_mode!r}")
    if regime_mode == "subsignal" and subsignal is None:
        raise ValueError("regime_mode 'subsignal' needs the sub-signal")
    out = {"regime": regime_vote(regime) if regime_mode == "label" else subsignal_vote(subsignal), "order_flow": tanh_vote(order_flow), "kernel": kernel_vote(deviation, reading)}
    if wss is not None:  # an event that does not act votes 0 with its whole weight
        out["surprise"] = tanh_vote(wss)
    return out


def weights_of(given: Mapping[str, float | Column] | None, votes: Sequence[str], surprise_weight: float = 1.0) -> dict[str, Column]:
    given = dict.fromkeys(VOTES, 1.0) if given is None else dict(given)
    missing = [v for v in VOTES if v not in given]
    if missing:
        raise ValueError(f"weights are missing {missing}")
    own = {v: given.get(v, surprise_weight) for v in votes}
    if all(not isinstance(w, Column) for w in own.values()) and sum(own.values()) <= 0:
        raise ValueError("the sum of weights must be positive")
    return {k: w if isinstance(w, Column) else F.lit(float(w)) for k, w in own.items()}


def score_of(votes: Mapping[str, Column], weights: Mapping[str, Column]) -> Column:
    total = sum((weights[k] for k in votes), F.lit(0.0))
    mean = sum((weights[k] * votes[k] for k in votes), F.lit(0.0))
    return mean / F.when(total > 0, total).otherwise(F.raise_error(F.lit("the sum of weights must be positive")).cast("double"))


def consensus(df: DataFrame, votes: Mapping[str, Column], weights: Mapping[str, float | Column] | None = None, gex: Column | None = None, band: Column | float = NEUTRAL_BAND, surprise_weight: float = 1.0) -> DataFrame:
    """Adds votes and weights (maps), score, label, and volatility_regime if a total exposure is given."""
    own = weights_of(weights, list(votes), surprise_weight)
    as_map = lambda m: F.create_map(*(x for k in votes for x in (F.lit(k), m[k])))
    df = df.withColumns({"votes": as_map(votes), "weights": as_map(own), "score": score_of(votes, own)}).withColumn("label", band_label(F.col("score"), band))
    return df if gex is None else df.withColumn("volatility_regime", gex_regime(gex)).withColumn("total_gex", gex)


def hit_rate(vote: Column, outcome: Column, w) -> Column:
    """Share of rows of a frame whose vote had the outcome's sign; a vote of 0 never hits."""
    return F.avg(F.when((sign(vote) != 0) & (sign(vote) == sign(outcome)), 1.0).otherwise(0.0)).over(w)


def dynamic_weights(df: DataFrame, votes: Sequence[str], outcome: str, window: int = WINDOW, floor: float = FLOOR, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """weight_<vote> from the resolved rows before this one: what the hit rate has above chance, plus a floor; null on the first row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    rates = {v: hit_rate(F.col(v), F.col(outcome), w) for v in votes}
    return df.withColumns({f"weight_{v}": F.when(r.isNotNull(), F.greatest(r - CHANCE, F.lit(0.0)) + floor) for v, r in rates.items()})


def held(df: DataFrame, columns: Sequence[str], every: int | Column = EVERY, least: int = LEAST, start: float | None = 1.0, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """Columns taken only on every ``every``-th row from ``least`` on and held between; ``start`` before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fresh = (F.col(order) >= least) & (F.col(order) % every == 0)
    return df.withColumns({c: F.coalesce(F.last(F.when(fresh, F.col(c)), ignorenulls=True).over(w), F.lit(start)) for c in columns})
