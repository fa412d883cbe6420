"""Hidden Markov regimes: Student-t and Gaussian emissions, fitted by expectation maximisation from many starts.

Starts, folds and series are rows of a task table; every fit is one group, the best start is an aggregation. Within a group
the recursions run over all states at once in scaled probabilities.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, settled, small, spread
from . import blockscan
from .blockscan import Blocks, Sums, scaled

STATES, STARTS, NU_START, ROUNDS, TOLERANCE, NU_LEAST, NU_MOST, VAR_LEAST, SPLITS = 3, 15, 8.0, 100, 1e-4, 2.05, 200.0, 1e-10, 8
#: Starts of one group; rows from which a series is fitted and decoded in blocks over many tasks.
TOGETHER, LONG = 16, 1 << 18
MODEL = "pi array<double>, a array<double>, mu array<double>, var array<double>, nu array<double>, score double"


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 10, then the asymptotic series."""
    x, out = np.array(x, np.float64), np.zeros(np.shape(x))
    while (low := x < 10).any():
        out = out - np.where(low, 1 / np.where(low, x, 1), 0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def log_emissions(x: np.ndarray, mu: np.ndarray, var: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """(*x, *parameters) for parameters (..., states); an infinite nu is a normal distribution."""
    x = x.reshape(*x.shape, *[1] * np.ndim(mu))
    z = (x - mu) ** 2 / var
    normal = ~np.isfinite(nu)
    v = np.where(normal, 1.0, nu)
    const = np.vectorize(lambda n: math.lgamma((n + 1) / 2) - math.lgamma(n / 2), otypes=[np.float64])(v)
    t = const - 0.5 * np.log(v * np.pi * var) - (v + 1) / 2 * np.log1p(z / v)
    return np.where(normal, -0.5 * (np.log(2 * np.pi * var) + z), t)


def solve_nu(term: np.ndarray | float) -> np.ndarray:
    """Roots of 1 + log(nu/2) - digamma(nu/2) + term, which falls in nu, by bisection within the bounds."""
    term = np.asarray(term, np.float64)
    g = lambda v: 1 + np.log(v / 2) - digamma(v / 2) + term
    low, high = np.full(term.shape, NU_LEAST), np.full(term.shape, NU_MOST)
    below, above = g(low) <= 0, g(high) >= 0
    for _ in range(60):
        mid = (low + high) / 2
        up = g(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.where(below, NU_LEAST, np.where(above, NU_MOST, (low + high) / 2))


def e_step(at: Blocks, a: np.ndarray, mu: np.ndarray, var: np.ndarray, nu: np.ndarray, b: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> Sums:
    """Sums of blocks whose carries are known."""
    x = at.x[:, :, None, None]
    alpha = blockscan.filtered(ahead, a, b, at)
    beta = blockscan.following(behind, a, b, at)
    z = (x - mu) ** 2 / var
    normal = ~np.isfinite(nu)
    v = np.where(normal, 1.0, nu)
    u = np.where(normal, 1.0, (v + 1) / (v + z))
    term = digamma((v + 1) / 2) - np.log((v + z) / 2) - u
    return blockscan.expected(alpha, beta, ahead, a, b, at, z, u, term, x - mu)


def m_step(s: Sums, mu: np.ndarray, nu: np.ndarray) -> tuple[np.ndarray, ...]:
    """pi, a, mu, var, nu of the sums; a normal state stays one."""
    var = np.maximum((s.w2 - s.w1 * s.w1 / s.w0) / s.weight, VAR_LEAST)
    new_nu = np.where(np.isfinite(nu), solve_nu(s.term / s.weight), nu)
    return s.start, s.moves / np.maximum(s.moves.sum(axis=2, keepdims=True), 1e-300), mu + s.w1 / s.w0, var, new_nu


class Models:
    """Parameters of many starts of one series while they are fitted; starts that have converged stand still."""

    def __init__(self, mu: np.ndarray, var: float, student: bool) -> None:
        n = len(mu)
        self.mu, self.var, self.nu = np.sort(mu, axis=1), np.full((n, STATES), max(var, VAR_LEAST)), np.full((n, STATES), NU_START if student else np.inf)
        self.pi, self.a, self.before = np.full((n, STATES), 1 / STATES), np.full((n, STATES, STATES), 1 / STATES), np.full(n, -np.inf)
        self.at, self.step = np.arange(n), 0

    def now(self) -> tuple[np.ndarray, ...]:
        """pi, a, mu, var, nu of those that still move."""
        return tuple(z[self.at] for z in (self.pi, self.a, self.mu, self.var, self.nu))

    def move(self, sums: Sums, score: np.ndarray) -> None:
        at = self.at
        self.pi[at], self.a[at], self.mu[at], self.var[at], self.nu[at] = m_step(sums, self.mu[at], self.nu[at])
        still = ~np.isfinite(score) | ((self.step > 0) & (np.abs(score - self.before[at]) < TOLERANCE * np.abs(self.before[at])))
        self.before[at], self.at = score, at[~still]
        self.step += 1

    def rest(self, score: np.ndarray) -> list[tuple]:
        return [(self.pi[i], self.a[i], self.mu[i], self.var[i], self.nu[i], float(score[i])) for i in range(len(score))]


def fit_many(x: np.ndarray, seeds: Sequence[int], student: bool = True, rounds: int = ROUNDS, trace: list | None = None) -> list[tuple]:
    """(pi, a, mu, var, nu, log likelihood) from each random start."""
    at = Blocks.cut(x)
    models = Models(np.stack([x[np.random.default_rng(s).choice(len(x), size=STATES, replace=False)] for s in seeds]), np.var(x), student)

    def scan(pi: np.ndarray, a: np.ndarray, mu: np.ndarray, var: np.ndarray, nu: np.ndarray) -> tuple:
        b, top = scaled(log_emissions(at.x, mu, var, nu))
        ahead, behind, score = blockscan.carries(pi, *blockscan.products(a, b, at))
        return b, ahead, behind, score + (top * at.valid[:, :, None]).sum(axis=(0, 1))

    for _ in range(rounds):
        pi, a, mu, var, nu = models.now()
        b, ahead, behind, score = scan(pi, a, mu, var, nu)
        if trace is not None:
            trace.append(float(score[0]))
        models.move(e_step(at, a, mu, var, nu, b, ahead, behind), score)
        if not len(models.at):
            break
    return models.rest(scan(models.pi, models.a, models.mu, models.var, models.nu)[3])


def filter_states(x: np.ndarray, pi: np.ndarray, a: np.ndarray, mu: np.ndarray, var: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """Filtered probabilities of one model, row by row."""
    at = Blocks.cut(x)
    b = scaled(log_emissions(at.x, *(z[None] for z in (mu, var, nu))))[0]
    ahead = blockscan.carries(pi[None], *blockscan.products(a[None], b, at))[0]
    return at.flat(blockscan.filtered(ahead, a[None], b, at))[:, 0]


def best_path(x: np.ndarray, pi: np.ndarray, a: np.ndarray, mu: np.ndarray, var: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """States of the likeliest path of one model."""
    at, la = Blocks.cut(x), np.log(a + 1e-300)[None]
    logb = log_emissions(at.x, *(z[None] for z in (mu, var, nu)))
    before = blockscan.best_before(np.log(pi + 1e-300)[None], blockscan.best_products(la, logb, at))
    back, end = blockscan.steps_back(before, la, logb, at)
    last = best_last(blockscan.entered(back)[:, 0], end[-1, 0])
    return at.flat(blockscan.traced(back, last[:, None]))[:, 0].astype(int)


def best_last(into: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best path's state at each block's end. into (blocks, states): the state before a block for each at its end; end: scores at the last end."""
    last = np.empty(len(into), np.int64)
    last[-1] = end.argmax()
    for k in range(len(last) - 1, 0, -1):
        last[k - 1] = into[k, last[k]]
    return last


def fit_once(x: np.ndarray, seed: int, student: bool = True, rounds: int = ROUNDS, trace: list | None = None) -> tuple:
    return fit_many(x, [seed], student, rounds, trace)[0]


def state_labels(mu: np.ndarray, var: np.ndarray, nu: np.ndarray) -> list[str]:
    """bull has the highest mean; of the other two the more volatile is bear."""
    if len(mu) != STATES:
        raise ValueError(f"labels need {STATES} states, got {len(mu)}")
    vol = np.sqrt(np.where(np.isfinite(nu), var * nu / np.where(np.isfinite(nu), nu - 2, 1), var))
    bull = int(np.argmax(mu))
    rest = sorted((s for s in range(STATES) if s != bull), key=lambda s: -vol[s])
    out = [""] * STATES
    out[bull], out[rest[0]], out[rest[1]] = "bull", "bear", "sideways"
    return out


def seeds_of(n: int = STARTS, seed: int = 42) -> list[int]:
    return [int(s) for s in np.random.default_rng(seed).integers(0, 2**32 - 1, size=n)]


def folds(df: DataFrame, splits: int = SPLITS, least_block: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, fold (from 1), train_end, test_end: expanding training, the last block takes what is over."""
    n = F.col("n")
    block = F.floor(n / (splits + 1))
    table = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("block", F.when(block < least_block, F.raise_error(F.lit("not enough rows for the walk-forward splits")).cast("bigint")).otherwise(block))
    fold = table.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    return fold.select(*keys, "fold", (F.col("block") * F.col("fold")).alias("train_end"), F.when(F.col("fold") == splits, n).otherwise(F.col("block") * (F.col("fold") + 1)).alias("test_end"))


def split_long(rows: DataFrame, sizes: DataFrame, names: Sequence[str], long: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups below so many rows, and those of the others if there are any (they are few: each has many rows). sizes: names, n."""
    far = [tuple(r[c] for c in names) for r in sizes.where(F.col("n") >= long).select(*names).collect()]
    if not far:
        return rows, None
    table = settled(rows.sparkSession.createDataFrame(far, rows.select(*names).schema))
    table = F.broadcast(table) if small(table) else table
    return rows.join(table, list(names), "left_anti"), rows.join(table, list(names), "left_semi")


def fit(df: DataFrame, returns: str = "log_return", fold_table: DataFrame | None = None, starts: Sequence[int] | None = None, student: bool = True, rounds: int = ROUNDS, keys: Sequence[str] = KEYS, long: int = LONG) -> DataFrame:
    """keys, fold, and the parameters of the best start (the first among equals). Without folds every row is training (fold 0).

    A group is a series, a fold and up to TOGETHER starts, whose recursions run side by side over blocks of its rows; groups
    spread over the cluster. A series of ``long`` rows or more is fitted over tasks that hold blocks of it instead, from the
    same starts to the same parameters. A start that fails drops out, a fold without any good one raises.
    """
    starts = list(seeds_of() if starts is None else starts)
    spark = df.sparkSession
    rows = df.select(*keys, F.col(ORDER).alias("__i"), F.col(returns).alias("__x")).where(F.col("__x").isNotNull())
    if fold_table is None:
        rows = rows.withColumn("fold", F.lit(0))
    else:
        rows = rows.join(fold_table.select(*keys, "fold", "train_end"), list(keys)).where("__i < train_end").drop("train_end")
    names = [*keys, "fold"]
    every = rows
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n")) if fold_table is None else fold_table.select(*names, F.col("train_end").alias("n"))
    rows, far = split_long(rows, sizes, names, long)
    parts = -(-len(starts) // TOGETHER)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    columns = [*names, "start", "pi", "a", "mu", "var", "nu", "score"]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, first = part.sort_values("__i")["__x"].to_numpy(np.float64), key[-1] * TOGETHER
        with np.errstate(all="ignore"):
            found = fit_many(x, starts[first : first + TOGETHER], student, rounds) if len(x) >= STATES else []
        good = [(first + i, *m) for i, m in enumerate(found) if math.isfinite(m[5]) and all(np.isfinite(v).all() for v in m[:4])]
        return pd.DataFrame([[*key[:-1], i, pi.tolist(), a.ravel().tolist(), mu.tolist(), var.tolist(), nu.tolist(), score] for i, pi, a, mu, var, nu, score in good], columns=columns)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    fitted = spread(rows, *names, "part").groupBy(*names, "part").applyInPandas(one, f"{kinds}, start int, {MODEL}")
    if far is not None:
        from .long_regimes import fit_blocks

        fitted = fitted.select(*names, *columns[len(names) :]).unionByName(fit_blocks(far, names, starts, student, rounds))
    best = F.max_by(F.struct("start", "pi", "a", "mu", "var", "nu", "score"), F.struct("score", -F.col("start")))
    wanted = every.select(*names).distinct()
    models = wanted.join(fitted.groupBy(*names).agg(best.alias("m")), names, "left")
    failed = F.raise_error(F.lit("no start of the regime model gave a finite likelihood")).cast("boolean")
    return models.where(F.when(F.col("m").isNull(), failed).otherwise(True)).select(*names, "m.*")


def decode(df: DataFrame, models: DataFrame, how: str = "filter", returns: str = "log_return", fold_table: DataFrame | None = None, keys: Sequence[str] = KEYS, long: int = LONG) -> DataFrame:
    """keys, fold, bar_idx, state, regime. 'filter' is causal (argmax of the forward probabilities), 'viterbi' looks at the whole path.

    models: one for each of keys and fold; fold 0 without folds. With folds each model decodes from the first row to its test
    block's end and gives its test block only. Series of ``long`` rows or more are decoded in blocks over many tasks.
    """
    if how not in ("filter", "viterbi"):
        raise ValueError(f"unknown decoding {how!r}")
    rows = df.select(*keys, F.col(ORDER).alias("bar_idx"), F.col(returns).alias("__x")).where(F.col("__x").isNotNull())
    met = models if fold_table is None else models.join(fold_table, [*keys, "fold"])
    first = "train_end" if fold_table is not None else None
    names = [*keys, "fold"]
    # How long a series is does not depend on its model: nothing is fitted to tell.
    if first:
        whole = rows.join(fold_table.select(*names, "test_end"), list(keys)).where("bar_idx < test_end").drop("test_end")
        sizes = fold_table.select(*names, F.col("test_end").alias("n"))
    else:
        every = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        whole, sizes = rows.withColumn("fold", F.lit(0)), every.withColumn("fold", F.lit(0))
    whole, far = split_long(whole, sizes, names, long)
    rows = whole.join(met.drop("score", "start"), names)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_idx")
        m = part.iloc[0]
        pi, a, mu, var, nu = (np.array(m[c], np.float64) for c in ("pi", "a", "mu", "var", "nu"))
        x, a = part["__x"].to_numpy(np.float64), a.reshape(STATES, STATES)
        states = filter_states(x, pi, a, mu, var, nu).argmax(axis=1) if how == "filter" else best_path(x, pi, a, mu, var, nu)
        names_of = np.array(state_labels(mu, var, nu))
        out = pd.DataFrame({**{c: part[c] for c in names}, "bar_idx": part["bar_idx"], "state": states.astype("int32"), "regime": names_of[states]})
        return out[part[first] <= part["bar_idx"]] if first else out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    out = spread(rows, *names).groupBy(*names).applyInPandas(one, f"{kinds}, bar_idx long, state int, regime string")
    if far is not None:
        from .long_regimes import decode_blocks

        own = met.join(far.select(*names).distinct(), names, "left_semi")
        found = decode_blocks(far.select(*names, F.col("bar_idx").alias("__i"), "__x"), own, names, how)
        if first:
            found = found.join(own.select(*names, "train_end"), names).where("train_end <= bar_idx").drop("train_end")
        out = out.unionByName(found)
    return out


def walk_forward_regimes(df: DataFrame, splits: int = SPLITS, returns: str = "log_return", starts: Sequence[int] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Causal labels: every test block decoded by a model of the rows before it."""
    table = folds(df, splits, keys=keys)
    return decode(df, fit(df, returns, table, starts, keys=keys), "filter", returns, table, keys)
