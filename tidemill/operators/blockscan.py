"""Hidden Markov recursions as associative scans over blocks of rows.

A row is a matrix (the transition times the row's emission on its columns); a stretch of rows is the product of its matrices, in
(sum, product) for the filter and the E-step or in (max, plus) for the best path. Blocks are multiplied out side by side, their
products carried along the blocks, and each block is gone through again from its carry. In one process this turns n steps of a
recursion into about 4 sqrt(n) steps of arrays; over a cluster each block is a task's work and only the products travel.

Arrays are (rows of a block, blocks, models, states). Rows behind a block's end leave everything as it is.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np

TINY = 1e-300


class Blocks(NamedTuple):
    """x (rows, blocks); which of them are rows; which block begins its series."""

    x: np.ndarray
    valid: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray], first: np.ndarray) -> Blocks:
        length = max(map(len, parts))
        x, valid = np.zeros((length, len(parts))), np.zeros((length, len(parts)), bool)
        for k, p in enumerate(parts):
            x[: len(p), k], valid[: len(p), k] = p, True
        return cls(x, valid, first)

    @classmethod
    def cut(cls, x: np.ndarray, length: int | None = None) -> Blocks:
        """One series in blocks of about the square root of its rows."""
        length = length or max(1, int(np.sqrt(len(x))))
        parts = [x[a : a + length] for a in range(0, len(x), length)]
        return cls.of(parts, np.arange(len(parts)) == 0)

    def flat(self, y: np.ndarray) -> np.ndarray:
        """Values (rows, blocks, ...) in the order of the series."""
        return y.swapaxes(0, 1)[self.valid.T]


def scaled(logb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions with the largest state at one, and the logarithm that was taken out."""
    top = logb.max(axis=-1)
    return np.exp(logb - top[..., None]), top


def kept(ok: np.ndarray, new: np.ndarray, old: np.ndarray) -> np.ndarray:
    return new if ok.all() else np.where(ok.reshape(-1, *[1] * (new.ndim - 1)), new, old)


def products(a: np.ndarray, b: np.ndarray, at: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """The product of each block's matrices (blocks, models, states, states) and its logarithmic scale."""
    n = a.shape[-1]
    p, log = np.broadcast_to(np.eye(n), (*b.shape[1:3], n, n)).copy(), np.zeros(b.shape[1:3])
    for t in range(len(b)):
        new = p if t == 0 and at.first.all() else p @ a
        if t == 0 and at.first.any():  # no transition leads into a series' first row
            new = np.where(at.first[:, None, None, None], p, new)
        new = new * b[t][:, :, None, :]
        norm = np.maximum(new.max(axis=(2, 3)), TINY)
        p, log = kept(at.valid[t], new / norm[:, :, None, None], p), kept(at.valid[t], log + np.log(norm), log)
    return p, log


def carries(pi: np.ndarray, p: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the products of one series' blocks: filtered probabilities before each block (pi before the first), likelihoods of what follows each, log likelihood."""
    ahead, behind, score, now = np.empty(p.shape[:3]), np.ones(p.shape[:3]), log.sum(axis=0), pi
    for k in range(len(p)):
        ahead[k] = now
        now = (now[:, None, :] @ p[k])[:, 0]
        total = np.maximum(now.sum(axis=1), TINY)
        now, score = now / total[:, None], score + np.log(total)
    now = behind[-1]
    for k in range(len(p) - 1, 0, -1):
        now = (p[k] @ now[:, :, None])[..., 0]
        now = now / np.maximum(now.max(axis=1), TINY)[:, None]
        behind[k - 1] = now
    return ahead, behind, score


def filtered(ahead: np.ndarray, a: np.ndarray, b: np.ndarray, at: Blocks) -> np.ndarray:
    """Filtered probabilities of every row."""
    out, now = np.empty_like(b), ahead
    for t in range(len(b)):
        new = (now[:, :, None, :] @ a)[:, :, 0]
        if t == 0 and at.first.any():
            new = np.where(at.first[:, None, None], now, new)
        new = new * b[t]
        now = kept(at.valid[t], new / np.maximum(new.sum(axis=-1), TINY)[..., None], now)
        out[t] = now
    return out


def following(behind: np.ndarray, a: np.ndarray, b: np.ndarray, at: Blocks) -> np.ndarray:
    """Likelihoods of what follows every row, each row's to a scale of its own."""
    out, now, across = np.empty_like(b), behind, a.swapaxes(-1, -2)
    for t in range(len(b) - 1, -1, -1):
        out[t] = now
        new = ((b[t] * now)[:, :, None, :] @ across)[:, :, 0]
        now = kept(at.valid[t], new / np.maximum(new.max(axis=-1), TINY)[..., None], now)
    return out


class Sums(NamedTuple):
    """Sufficient statistics of an E-step, by model: they add up over blocks. Moments are about the means that the step began with."""

    start: np.ndarray
    moves: np.ndarray
    weight: np.ndarray
    w0: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    term: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(x + y for x, y in zip(self, other)))

    def packed(self) -> np.ndarray:
        return np.concatenate([x.reshape(len(x), -1) for x in self], axis=1)

    @classmethod
    def unpacked(cls, flat: np.ndarray, n: int) -> Sums:
        parts = np.split(flat, np.cumsum([n, n * n, n, n, n, n]), axis=1)
        return cls(*(p.reshape(-1, n, n) if i == 1 else p for i, p in enumerate(parts)))


def expected(alpha: np.ndarray, beta: np.ndarray, ahead: np.ndarray, a: np.ndarray, b: np.ndarray, at: Blocks, z: np.ndarray, u: np.ndarray, term: np.ndarray, away: np.ndarray) -> Sums:
    """z: squared distances over the variance; u: weights of the observations; away: x less the mean."""
    ok = at.valid[:, :, None, None]
    gamma = alpha * beta
    gamma = np.where(ok, gamma / np.maximum(gamma.sum(axis=-1, keepdims=True), TINY), 0.0)
    before, w = np.concatenate([ahead[None], alpha[:-1]]), b * beta
    whole = ((before[..., None, :] @ a)[..., 0, :] * w).sum(axis=-1)
    counted = at.valid[:, :, None] & ~((np.arange(len(b)) == 0)[:, None] & at.first)[:, :, None]
    w = np.where(counted[..., None], w / np.maximum(whole, TINY)[..., None], 0.0)
    flat = lambda y: y.reshape(-1, *y.shape[2:]).swapaxes(0, 1)
    moves = a * (flat(before).swapaxes(-1, -2) @ flat(w))
    wu = gamma * u
    some = lambda y: y.sum(axis=(0, 1))
    return Sums(some(gamma[:1] * at.first[None, :, None, None]), moves, some(gamma), some(wu), some(wu * away), some(wu * away * away), some(gamma * term))


def best_products(la: np.ndarray, logb: np.ndarray, at: Blocks) -> np.ndarray:
    """(max, plus) products of each block: the best score of a way from a state before the block to one at its end."""
    n = la.shape[-1]
    start = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
    p = np.broadcast_to(start, (*logb.shape[1:3], n, n)).copy()
    for t in range(len(logb)):
        new = (p[..., :, None] + la[:, None]).max(axis=-2)
        if t == 0 and at.first.any():
            new = np.where(at.first[:, None, None, None], p, new)
        p = kept(at.valid[t], new + logb[t][:, :, None, :], p)
    return p


def best_before(pi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Scores of the best ways that end before each block of one series (log pi before the first)."""
    out, now = np.empty(p.shape[:3]), pi
    for k in range(len(p)):
        out[k] = now
        now = (now[:, :, None] + p[k]).max(axis=1)
    return out


def steps_back(before: np.ndarray, la: np.ndarray, logb: np.ndarray, at: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """For every row and state the best state of the row before (the first of equals), and the scores at each block's end."""
    back, now = np.empty(logb.shape, np.int8), before
    n = la.shape[-1]
    for t in range(len(logb)):
        ways = now[..., :, None] + la
        came, new = ways.argmax(axis=-2), ways.max(axis=-2)
        if t == 0 and at.first.any():
            came, new = np.where(at.first[:, None, None], np.arange(n), came), np.where(at.first[:, None, None], now, new)
        new = new + logb[t]
        back[t], now = kept(at.valid[t], came, np.broadcast_to(np.arange(n), came.shape)), kept(at.valid[t], new, now)
    return back, now


def entered(back: np.ndarray) -> np.ndarray:
    """For each state at a block's end, the state before the block on its best way."""
    at = np.broadcast_to(np.arange(back.shape[-1], dtype=np.int8), back.shape[1:])
    for t in range(len(back) - 1, -1, -1):
        at = np.take_along_axis(back[t], at, axis=-1)
    return at


def traced(back: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The states of every row, from those at each block's end (blocks, models)."""
    out, now = np.empty(back.shape[:3], np.int8), last
    for t in range(len(back) - 1, -1, -1):
        out[t] = now
        now = np.take_along_axis(back[t], now[..., None].astype(np.int64), axis=-1)[..., 0]
    return out
