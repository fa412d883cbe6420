"""Online models: Bayesian changepoints and the conformal gate. The same state objects serve batch groups and streams."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, spread


class Changepoints:
    """Run-length posterior under a normal-inverse-gamma prior; runs beyond ``most`` are cut and the rest renormalised.

    kappa and alpha depend on the run length alone, so only the log posterior, the means and the betas are state.
    """

    def __init__(self, hazard: float = 0.01, most: int = 500, mu: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1.0) -> None:
        if not 0 < hazard < 1:
            raise ValueError("hazard must be in (0, 1)")
        self.hazard, self.most, self.prior = hazard, most, (mu, kappa, alpha, beta)
        runs = np.arange(most + 1)
        self.kappa, self.alpha = kappa + runs, alpha + runs / 2
        df = 2 * self.alpha
        self.constant = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(d * math.pi) for d in df])
        self.logp, self.mean, self.beta = np.zeros(1), np.array([mu]), np.array([beta])

    def update(self, x: float, k: int = 5) -> tuple[float, float, int]:
        """P(run <= k), expected run, most likely run (the shortest among equals)."""
        n = len(self.logp)
        kappa, alpha, d = self.kappa[:n], self.alpha[:n], x - self.mean
        s2 = self.beta * (kappa + 1) / (alpha * kappa)
        joint = self.logp + self.constant[:n] - 0.5 * np.log(s2) - (alpha + 0.5) * np.log1p(d * d / (2 * alpha * s2))
        top = joint.max()
        total = top + math.log(np.exp(joint - top).sum())  # change and growth share the predictive mass
        logp = np.concatenate([[total + math.log(self.hazard)], joint + math.log1p(-self.hazard)]) - total
        mean = np.concatenate([[self.prior[0]], self.mean + d / (kappa + 1)])
        beta = np.concatenate([[self.prior[3]], self.beta + kappa * d * d / (2 * (kappa + 1))])
        if len(logp) > self.most:
            logp, mean, beta = logp[: self.most], mean[: self.most], beta[: self.most]
            logp = logp - (logp.max() + math.log(np.exp(logp - logp.max()).sum()))
        self.logp, self.mean, self.beta = logp, mean, beta
        p = np.exp(logp)
        return float(p[: k + 1].sum()), float(np.arange(len(p)) @ p), int(np.argmax(logp))

    def state(self) -> bytes:
        return np.stack([self.logp, self.mean, self.beta]).tobytes()

    def restore(self, state: bytes) -> Changepoints:
        self.logp, self.mean, self.beta = (x.copy() for x in np.frombuffer(state, np.float64).reshape(3, -1))
        return self


class Gate:
    """An adaptive conformal interval around scale * score; before ``warmup`` updates it is infinite and abstains."""

    def __init__(self, alpha: float = 0.1, scale: float = 1.0, gamma: float = 0.05, fade: float = 0.0, power: float = 0.7, warmup: int = 60) -> None:
        if not 0 < alpha < 1:
            raise ValueError("alpha must be in (0, 1)")
        if not 0.5 < power < 1:
            raise ValueError("the power of the step's fade must be in (0.5, 1)")
        self.alpha, self.scale, self.gamma, self.fade, self.power, self.warmup = alpha, scale, gamma, fade, power, warmup
        self.t, self.errors, self.width = 0, [], math.nan

    def decide(self, score: float) -> tuple[str, float, float]:
        if self.t < self.warmup or math.isnan(self.width):
            return "abstain", -math.inf, math.inf
        low, high = self.scale * score - self.width, self.scale * score + self.width
        return "long" if low > 0 else "short" if high < 0 else "abstain", low, high

    def update(self, score: float, realised: float) -> None:
        error = abs(realised - self.scale * score)
        self.errors = [*self.errors, error][-self.warmup :] if self.warmup else [error]
        self.t += 1
        if math.isnan(self.width):
            self.width = error if error > 0 else 1e-6
            return
        step = self.gamma / (1 + self.fade * self.t) ** self.power * max(sum(self.errors) / len(self.errors), 1e-12)
        self.width = max(self.width + step * ((error > self.width) - self.alpha), 1e-12)


def changepoints(df: DataFrame, value: str, hazard: float = 0.01, k: int = 5, most: int = 500, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, bar_idx, change_prob, expected_run, map_run. One group a series: the recursion has no parallel form within it."""
    Changepoints(hazard, most)  # arguments are checked where the plan is made
    names = list(keys)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, model = part.sort_values("bar_idx"), Changepoints(hazard, most)
        out = [model.update(float(x), k) for x in part["x"]]
        return pd.DataFrame({**dict(zip(names, ([v] * len(part) for v in key))), "bar_idx": part["bar_idx"].to_numpy(), "change_prob": [o[0] for o in out], "expected_run": [o[1] for o in out], "map_run": [o[2] for o in out]})

    rows = df.where(F.col(value).isNotNull()).select(*names, F.col(ORDER).alias("bar_idx"), F.col(value).cast("double").alias("x"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return spread(rows, *names).groupBy(*names).applyInPandas(one, f"{kinds}, bar_idx long, change_prob double, expected_run double, map_run int")


def slope_through_origin(score: str, realised: str):
    """Sum of products over sum of squares; 0 where all scores are 0."""
    return F.coalesce(F.try_divide(F.sum(F.col(score) * F.col(realised)), F.sum(F.col(score) * F.col(score))), F.lit(0.0))


def conformal_gate(df: DataFrame, score: str, realised: str, alpha: float = 0.1, warmup: int = 60, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, bar_idx, action, lower, upper, covered, scale: the scale is fitted on the first ``warmup`` rows and frozen. Too short a series raises."""
    Gate(alpha, warmup=warmup)
    names = list(keys)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_idx")
        s, r = part["s"].to_numpy(np.float64), part["r"].to_numpy(np.float64)
        if len(s) <= warmup:
            raise ValueError("a gate needs more rows than its warm-up")
        square = float(s[:warmup] @ s[:warmup])
        gate = Gate(alpha, float(s[:warmup] @ r[:warmup]) / square if square else 0.0, warmup=warmup)
        rows = []
        for a, b in zip(s.tolist(), r.tolist()):
            action, low, high = gate.decide(a)
            rows.append((action, low, high, low <= b <= high))
            gate.update(a, b)
        out = pd.DataFrame(rows, columns=["action", "lower", "upper", "covered"])
        return pd.DataFrame({**dict(zip(names, ([v] * len(part) for v in key))), "bar_idx": part["bar_idx"].to_numpy(), **out, "scale": gate.scale})

    rows = df.where(F.col(score).isNotNull() & F.col(realised).isNotNull()).select(*names, F.col(ORDER).alias("bar_idx"), F.col(score).cast("double").alias("s"), F.col(realised).cast("double").alias("r"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return spread(rows, *names).groupBy(*names).applyInPandas(one, f"{kinds}, bar_idx long, action string, lower double, upper double, covered boolean, scale double")
