"""Rank statistics of weighted points on arrays: Kendall's sum of signs by digits of ranks, Spearman's ranks, ties.

Digits have base BASE. Two ranks differ first in one digit; the points that agree in all higher digits form a block,
and within a block, in the order of x, a point is concordant with the earlier points of smaller digit and discordant
with those of larger digit. So one pass per digit with a running vector of BASE counts gives the sum of all signs.
"""

from __future__ import annotations

import numpy as np

BITS = 5
BASE = 1 << BITS


def levels(largest: int) -> int:
    """How many digits ranks up to `largest` have."""
    return max(1, -(-int(largest).bit_length() // BITS))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where, in rows sorted by the columns, a new combination starts."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def signs(block: np.ndarray, x: np.ndarray, digit: np.ndarray, n: np.ndarray, before: np.ndarray | None = None,
          tied: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over rows of n times (weight of earlier rows of their block with a smaller digit, less those with a larger
    one), for rows sorted by block and x; rows of equal x do not count for each other.

    `before` are the counts by digit of the first block ahead of these rows, and `tied` those of them with the first
    row's x. Returns the sum and both vectors for the rows that follow, if they go on with the last block and x.
    """
    before = np.zeros(BASE) if before is None else before
    tied = np.zeros(BASE) if tied is None else tied
    first_block, first_x = runs(block), runs(block, x)
    of_block = np.repeat(np.arange(len(first_block)), np.diff(np.append(first_block, len(x))))
    of_x = np.repeat(np.arange(len(first_x)), np.diff(np.append(first_x, len(x))))
    total, after, held = 0.0, np.zeros(BASE), np.zeros(BASE)
    weight = n.astype(float)
    for g in range(BASE):
        own = digit == g
        seen = np.concatenate([[0.0], np.cumsum(np.where(own, weight, 0.0))])
        start = seen[first_block]
        start[0] -= before[g]  # the first block began earlier
        earlier = seen[first_x] - start[of_block[first_x]]
        earlier[0] -= tied[g]
        earlier = earlier[of_x]
        total += float((weight * earlier * ((digit > g) * 1.0 - (digit < g))).sum())
        after[g] = seen[-1] - start[-1]
        held[g] = seen[-1] - seen[first_x[-1]] + (tied[g] if len(first_x) == 1 else 0.0)
    return total, after, held


def kendall_sum(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant minus discordant pairs of weighted points."""
    if not len(x):
        return 0.0
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    rank = np.unique(y[order], return_inverse=True)[1]
    total = 0.0
    for level in range(levels(rank.max())):
        block, digit = rank >> (BITS * (level + 1)), (rank >> (BITS * level)) & (BASE - 1)
        by_block = np.argsort(block, kind="stable")
        total += signs(block[by_block], x[by_block], digit[by_block], n[by_block])[0]
    return total


def average_ranks(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Average rank of each value among points that stand for n rows."""
    _, which = np.unique(v, return_inverse=True)
    size = np.bincount(which, n)
    upto = np.cumsum(size)
    return (upto - (size - 1) / 2)[which]


def tie_sums(v: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Sums over equal values of t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5)."""
    t = np.bincount(np.unique(v, return_inverse=True)[1], n)
    return float((t * (t - 1) / 2).sum()), float((t * (t - 1) * (t - 2)).sum()), float((t * (t - 1) * (2 * t + 5)).sum())
