"""Regimes of series too long for one task: fits and decodings whose tasks are blocks of rows.

A series is stored as blocks of bounded length. Each round of a fit multiplies every block's matrices out (a task's work), carries
the products along the blocks of a (series, start), gives the carries back to the blocks, and adds up their sufficient
statistics; the driver sees some 30 numbers for each start. Nothing holds a series: not a task, not the driver.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blockscan
from .blockscan import Blocks, Sums, scaled
from .regimes import MODEL, ROUNDS, STATES, Models, best_last, e_step, log_emissions, state_labels

#: Rows of a block, and blocks that are in memory together.
BLOCK, BATCH = 4096, 8


@contextmanager
def small_batches(spark, rows: int = BATCH) -> Iterator[None]:
    """A row is a block of some 32 KB or more: few of them in an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def blocks_of(rows: DataFrame, names: Sequence[str], block: int = BLOCK) -> DataFrame:
    """names, block, first, start (rows before it), bar_idx, x (arrays in order): rows (names, __i, __x) in blocks of a range of __i."""
    own = rows.groupBy(*names, F.floor(F.col("__i") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__r"))
    own = own.select(*names, "block", F.col("__r.__i").alias("bar_idx"), F.col("__r.__x").alias("x"))
    by = Window.partitionBy(*names).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.select(*names, "block", F.size("x").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(by), F.lit(0))).drop("n")  # a row a block
    return own.join(ends, [*names, "block"]).withColumn("first", F.col("start") == 0)


def schema_of(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)


def gathered(part: pd.DataFrame) -> Blocks:
    return Blocks.of([np.asarray(x, np.float64) for x in part["x"]], part["first"].to_numpy(bool))


def multiplied(blocks: DataFrame, tasks: dict[tuple, tuple], names: Sequence[str], best: bool = False) -> DataFrame:
    """names, block, matrices (of all the series' models, one after another), logs. tasks: the parameters by series."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for key, part in whole.groupby(list(names), sort=False):
                pi, a, mu, var, nu = tasks[key if isinstance(key, tuple) else (key,)]
                at = gathered(part)
                logb = log_emissions(at.x, mu, var, nu)
                if best:
                    p, log = blockscan.best_products(np.log(a + 1e-300), logb, at), np.zeros((len(part), len(a)))
                else:
                    b, top = scaled(logb)
                    p, log = blockscan.products(a, b, at)
                    log = log + (top * at.valid[:, :, None]).sum(axis=0)
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in names}, "block": part["block"].to_numpy(), "matrices": [m.ravel() for m in p], "logs": list(log)})

    return blocks.select(*names, "block", "first", "x").mapInPandas(run, f"{schema_of(blocks, names)}, block bigint, matrices array<double>, logs array<double>")


def carried(products: DataFrame, tasks: dict[tuple, tuple], names: Sequence[str], best: bool = False) -> DataFrame:
    """names, block, ahead, behind, scores: what each block begins with, from the products of its series (a matrix a block)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        pi = tasks[key][0]
        p = np.stack(part["matrices"].to_list()).reshape(len(part), len(pi), STATES, STATES)
        if best:
            ahead = blockscan.best_before(np.log(pi + 1e-300), p)
            behind, score = np.zeros_like(ahead), np.zeros(len(pi))
        else:
            ahead, behind, score = blockscan.carries(pi, p, np.stack(part["logs"].to_list()))
        return pd.DataFrame({**dict(zip(names, key)), "block": part["block"].to_numpy(), "ahead": [z.ravel() for z in ahead], "behind": [z.ravel() for z in behind], "scores": [score] * len(part)})

    return products.groupBy(*names).applyInPandas(run, f"{schema_of(products, names)}, block bigint, ahead array<double>, behind array<double>, scores array<double>")


def statistics(blocks: DataFrame, carries: DataFrame, tasks: dict[tuple, tuple], names: Sequence[str]) -> DataFrame:
    """names, at, value: the sums of all models over all blocks, and their scores, as one vector by place."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for whole in parts:
            for key, part in whole.groupby(list(names), sort=False):
                key = key if isinstance(key, tuple) else (key,)
                pi, a, mu, var, nu = tasks[key]
                at, shape = gathered(part), (len(part), len(pi), STATES)
                ahead, behind = (np.stack(part[c].to_list()).reshape(shape) for c in ("ahead", "behind"))
                sums = e_step(at, a, mu, var, nu, scaled(log_emissions(at.x, mu, var, nu))[0], ahead, behind).packed()
                scores = np.stack(part["scores"].to_list())[at.first].sum(axis=0)  # a series has one first block
                own = np.concatenate([sums, scores[:, None]], axis=1).ravel()
                total[key] = total[key] + own if key in total else own
        for key, own in total.items():
            yield pd.DataFrame({**dict(zip(names, key)), "at": np.arange(len(own)), "value": own})

    met = blocks.select(*names, "block", "first", "x").join(carries, [*names, "block"])
    each = met.mapInPandas(run, f"{schema_of(blocks, names)}, at int, value double")
    return each.groupBy(*names, "at").agg(F.sum("value").alias("value"))


def drawn(blocks: DataFrame, seeds: Sequence[int], names: Sequence[str]) -> dict[tuple, tuple[np.ndarray, float]]:
    """Means that the starts begin with (rows at drawn places) and the variance, by series."""
    x = blocks.select(*names, F.explode("x").alias("x")).groupBy(*names).agg(F.count("x").alias("n"), F.var_pop("x").alias("var"))
    told = {tuple(r[c] for c in names): r for r in x.collect()}  # a row a series
    wanted = [(*k, s, j, int(i)) for k, r in told.items() for s, seed in enumerate(seeds) for j, i in enumerate(np.random.default_rng(seed).choice(r["n"], size=STATES, replace=False))]
    spark = blocks.sparkSession
    ranks = spark.createDataFrame(wanted, f"{schema_of(blocks, names)}, s int, j int, rank bigint")
    near = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.size("x"))
    found = blocks.join(ranks, list(names)).where(near).select(*names, "s", "j", F.element_at("x", (F.col("rank") - F.col("start") + 1).cast("int")).alias("x")).collect()
    out = {k: (np.zeros((len(seeds), STATES)), float(r["var"])) for k, r in told.items()}
    for r in found:
        out[tuple(r[c] for c in names)][0][r["s"], r["j"]] = r["x"]
    return out


def fit_blocks(rows: DataFrame, names: Sequence[str], starts: Sequence[int], student: bool = True, rounds: int = ROUNDS, block: int | None = None) -> DataFrame:
    """names, start and the parameters of every start of finite likelihood. rows: names, __i, __x. The starts are those of the fit in one task."""
    spark = rows.sparkSession
    with small_batches(spark):
        blocks = blocks_of(rows, names, block or BLOCK).persist()
        try:
            fits = {k: Models(mu, var, student) for k, (mu, var) in drawn(blocks, starts, names).items()}

            def scores(now: dict[tuple, tuple]) -> DataFrame:
                live = blocks.where(F.struct(*names).isin([F.struct(*(F.lit(v) for v in k)) for k in now])) if len(now) < len(fits) else blocks
                return statistics(live, carried(multiplied(live, now, names), now, names), now, names)

            def vectors(now: dict[tuple, tuple]) -> dict[tuple, np.ndarray]:
                out = {k: np.zeros((len(z[0]), STATES * (STATES + 6) + 1)) for k, z in now.items()}
                for r in scores(now).collect():
                    out[tuple(r[c] for c in names)].ravel()[r["at"]] = r["value"]
                return out

            for _ in range(rounds):
                now = {k: m.now() for k, m in fits.items() if len(m.at)}
                if not now:
                    break
                for k, v in vectors(now).items():
                    fits[k].move(Sums.unpacked(v[:, :-1], STATES), v[:, -1])
            last = vectors({k: (m.pi, m.a, m.mu, m.var, m.nu) for k, m in fits.items()})
        finally:
            blocks.unpersist()
    out = []
    for k, m in fits.items():
        for i, (pi, a, mu, var, nu, score) in enumerate(m.rest(last[k][:, -1])):
            if math.isfinite(score) and all(np.isfinite(v).all() for v in (pi, a, mu, var)):
                out.append((*k, i, pi.tolist(), a.ravel().tolist(), mu.tolist(), var.tolist(), nu.tolist(), score))
    return spark.createDataFrame(out, f"{schema_of(rows, names)}, start int, {MODEL}")


def decode_blocks(rows: DataFrame, models: DataFrame, names: Sequence[str], how: str, block: int | None = None) -> DataFrame:
    """names, bar_idx, state, regime of every row. rows: names, __i, __x; models: a row for each of names."""
    spark, best = rows.sparkSession, how == "viterbi"
    tasks = {tuple(r[c] for c in names): (np.array([r["pi"]]), np.array(r["a"]).reshape(1, STATES, STATES), *(np.array([r[c]]) for c in ("mu", "var", "nu"))) for r in models.collect()}  # a row a series and fold
    kinds = schema_of(rows, names)
    with small_batches(spark):
        blocks = blocks_of(rows, names, block or BLOCK)
        carries = carried(multiplied(blocks, tasks, names, best), tasks, names, best)
        met = blocks.join(carries, [*names, "block"])
        if best:
            met = met.join(last_states(met, tasks, names), [*names, "block"])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in parts:
                for key, part in whole.groupby(list(names), sort=False):
                    key = key if isinstance(key, tuple) else (key,)
                    pi, a, mu, var, nu = tasks[key]
                    at = gathered(part)
                    logb = log_emissions(at.x, mu, var, nu)
                    ahead = np.stack(part["ahead"].to_list()).reshape(len(part), 1, STATES)
                    if best:
                        back = blockscan.steps_back(ahead, np.log(a + 1e-300), logb, at)[0]
                        states = blockscan.traced(back, part["last"].to_numpy(np.int64)[:, None])
                    else:
                        states = blockscan.filtered(ahead, a, scaled(logb)[0], at).argmax(axis=-1)
                    states = at.flat(states)[:, 0].astype("int32")
                    labels = np.array(state_labels(mu[0], var[0], nu[0]))
                    yield pd.DataFrame({**dict(zip(names, key)), "bar_idx": np.concatenate(part["bar_idx"].to_list()), "state": states, "regime": labels[states]})

        out = met.mapInPandas(run, f"{kinds}, bar_idx long, state int, regime string").persist()
        out.count()  # while batches are small
    return out


def last_states(met: DataFrame, tasks: dict[tuple, tuple], names: Sequence[str]) -> DataFrame:
    """names, block, last: the best path's state at each block's end. A block tells where each of its end states comes from; that is followed back along the blocks."""

    def ways(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for key, part in whole.groupby(list(names), sort=False):
                pi, a, mu, var, nu = tasks[key if isinstance(key, tuple) else (key,)]
                at = gathered(part)
                ahead = np.stack(part["ahead"].to_list()).reshape(len(part), 1, STATES)
                back, end = blockscan.steps_back(ahead, np.log(a + 1e-300), log_emissions(at.x, mu, var, nu), at)
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in names}, "block": part["block"].to_numpy(), "into": [z.ravel().astype(np.int32) for z in blockscan.entered(back)], "ends": [z.ravel() for z in end]})

    def follow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        return pd.DataFrame({**dict(zip(names, key)), "block": part["block"].to_numpy(), "last": best_last(np.stack(part["into"].to_list()), np.asarray(part["ends"].iloc[-1]))})

    kinds = schema_of(met, names)
    told = met.mapInPandas(ways, f"{kinds}, block bigint, into array<int>, ends array<double>")
    return told.groupBy(*names).applyInPandas(follow, f"{kinds}, block bigint, last int")
