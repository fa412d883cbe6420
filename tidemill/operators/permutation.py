"""Permutation tests whose permutations are functions of a key, not lists.

A Feistel network over the numbers below a power of four is a permutation of them for every key; walking on until a number below n
is met makes it one of 0 .. n - 1. So a row's place in permutation k is computed from (row number, k) alone: no list is held,
any task can take any rows and any permutations, and a lost task draws the same again.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, spread
from ..functions.prefix import running

ROUNDS, MULTIPLIER, OTHER, WORD = 6, 0x9E3779B1, 0x85EBCA6B, 0xFFFFFFFF
#: Permutations that a task draws together.
TOGETHER = 25


def round_keys(seed: int, k: int) -> list[int]:
    """32-bit keys of permutation k, by a linear congruence that is stirred."""
    x, out = (seed * MULTIPLIER + k * OTHER + 1) & WORD, []
    for _ in range(ROUNDS):
        x = (x * 1664525 + 1013904223) & WORD
        out.append((x ^ x >> 15) * OTHER & WORD)
    return out


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permuted(ranks: np.ndarray, n: int, seed: int, k: int) -> np.ndarray:
    """Places of these row numbers in permutation k of 0 .. n - 1."""
    bits = half_bits(n)
    mask, keys = np.uint64((1 << bits) - 1), [np.uint64(x) for x in round_keys(seed, k)]
    word, shift = np.uint64(WORD), np.uint64(bits)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            f = (right * np.uint64(MULTIPLIER) + key) & word
            f = (f ^ f >> np.uint64(15)) * np.uint64(OTHER) & word
            left, right = right, left ^ ((f ^ f >> np.uint64(13)) & mask)
        return left << shift | right

    out = once(ranks.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def label_edges(df: DataFrame, permutations: int = 500, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, trend_edge, trend_p, n_trend, reversion_edge, reversion_p, n_reversion.

    df: keys, bar_idx, side (1, -1 or 0: the label), up (1.0 or 0.0) and toward (1.0, 0.0 or null). The trend edge is the share
    of sided rows whose side was right, less a half; the reversion edge the share of toward among unsided rows that have it.
    Labels are shuffled, outcomes stay; p is the share of permutations, the true labels among them, with no smaller edge, of
    those that have one.

    Labels in sorted order are a permutation of the labels like any other, so a row's shuffled label is told by its place and
    the counts of labels. Tasks take (rows, permutations) in any cut; only sums meet.
    """
    names = list(keys)
    counts = df.groupBy(*names).agg(F.count("*").alias("__n"), F.sum(F.expr("int(side > 0)")).alias("__bull"), F.sum(F.expr("int(side < 0)")).alias("__bear"))
    told = {tuple(r[c] for c in names): (r["__n"], r["__bull"], r["__bear"]) for r in counts.collect()}  # a row a series
    # Plus permutation 0, the labels as they are.
    parts = -(-permutations // TOGETHER)
    ranked = running(df, {"__rank": ("sum", F.lit(1))}, keys, ORDER)
    rows = ranked.select(*names, (F.col("__rank") - 1).alias("rank"), "side", "up", "toward").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts))))
    rows = spread(rows, *names, "part", "rank")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for key, part in whole.groupby([*names, "part"], sort=False):
                n, bull, bear = told[key[:-1]]
                up, toward, rank = part["up"].to_numpy(np.float64), part["toward"].to_numpy(np.float64), part["rank"].to_numpy()
                known = ~np.isnan(toward)
                for k in range((key[-1] - 1) * TOGETHER + 1, min(key[-1] * TOGETHER, permutations) + 1) if key[-1] else (0,):
                    if k:
                        place = permuted(rank, n, seed, k)
                        side = (place < bull).astype(int) - ((place >= bull) & (place < bull + bear))
                    else:
                        side = part["side"].to_numpy()
                    back = (side == 0) & known
                    own = np.array([up[side > 0].sum() + (1 - up[side < 0]).sum(), (side != 0).sum(), toward[back].sum(), back.sum()])
                    at = (*key[:-1], k)
                    total[at] = total[at] + own if at in total else own
        yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=[*names, "k", "right", "n_trend", "back", "n_reversion"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    each = rows.mapInPandas(sums, f"{kinds}, k int, right double, n_trend double, back double, n_reversion double")
    each = each.groupBy(*names, "k").agg(*(F.sum(c).alias(c) for c in ("right", "n_trend", "back", "n_reversion")))
    edge = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.when(F.col(n) > 0, F.col(n)) - 0.5)
    each = each.withColumns({"trend": edge("right", "n_trend"), "reversion": edge("back", "n_reversion")})
    seen = each.where("k = 0").select(*names, F.col("trend").alias("trend_edge"), F.col("n_trend").cast("bigint"), F.col("reversion").alias("reversion_edge"), F.col("n_reversion").cast("bigint"))
    met = each.where("k > 0").select(*names, "trend", "reversion").join(F.broadcast(seen) if len(told) <= 100_000 else seen, names, "right")
    p = lambda x: F.when(F.any_value(f"{x}_edge").isNotNull() & (F.count(x) > 0), (1 + F.sum(F.when(F.col(x) >= F.col(f"{x}_edge"), 1).otherwise(0))) / (1 + F.count(x))).alias(f"{x}_p")
    shown = [F.any_value(c).alias(c) for c in ("trend_edge", "n_trend", "reversion_edge", "n_reversion")]
    return met.groupBy(*names).agg(*shown, p("trend"), p("reversion")).select(*names, "trend_edge", "trend_p", "n_trend", "reversion_edge", "reversion_p", "n_reversion")
