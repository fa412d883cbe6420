"""Means of the largest values of a sliding window."""
from __future__ import annotations

import math

import numpy as np


class LargestSum:
    """Values by rank, the largest first, in a Fenwick tree of counts and sums: a value enters, leaves, and the k largest are summed, each in a logarithm of the ranks."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.tolist()
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-values, kind="stable")] = np.arange(1, len(values) + 1)
        self.rank, self.n = rank.tolist(), len(values)
        self.counts, self.sums = [0] * (self.n + 1), [0.0] * (self.n + 1)
        self.top = 1 << max(self.n.bit_length() - 1, 0)

    def add(self, row: int, sign: int = 1) -> None:
        at, v, counts, sums, n = self.rank[row], sign * self.values[row], self.counts, self.sums, self.n
        while at <= n:
            counts[at] += sign
            sums[at] = sums[at] + v if counts[at] else 0.0  # an empty node holds no rounding
            at += at & -at

    def largest(self, k: int) -> float:
        at, step, total, counts, sums = 0, self.top, 0.0, self.counts, self.sums
        while step:
            nxt = at + step
            if nxt <= self.n and counts[nxt] <= k:
                at, k, total = nxt, k - counts[nxt], total + sums[nxt]
            step >>= 1
        return total


def tail_size(n: int, alpha: float) -> int:
    return max(1, math.ceil(round(alpha * n, 9)))


def sliding_tail_means(values: np.ndarray, window: int, alpha: float) -> np.ndarray:
    """For each row the mean of the worst ceil(alpha n) of the n values up to it in the window. NaN values do not count; without any the mean is 0."""
    found, known = np.zeros(len(values)), ~np.isnan(values)
    held, n = LargestSum(np.where(known, values, -np.inf)), 0
    for t, ok in enumerate(known.tolist()):
        if ok:
            held.add(t)
            n += 1
        if t >= window and known[t - window]:
            held.add(t - window, -1)
            n -= 1
        if n:
            k = tail_size(n, alpha)
            found[t] = held.largest(k) / k
    return found
