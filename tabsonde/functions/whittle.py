"""Likelihood of ARMA models from a periodogram (Whittle), maximised by scoring steps.

With the powers I(k) = |transform|^2 / n at the frequencies k = 1 .. (n - 1) / 2 and the spectrum s^2 g(k), where
g = |1 + sum of MA terms|^2 / |1 - sum of AR terms|^2, all that a step needs are sums over frequencies. So a series may
lie in one task or be spread over many.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from tabsonde.functions.lagged import Lagged, arma, long_order

STEPS, TOLERANCE = 60, 1e-9


def frequencies(n: int) -> int:
    """How many frequencies count: neither zero nor the half of all."""
    return (n - 1) // 2


def sums(angle: np.ndarray, power: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """[count, sum of I / g, sum of log g, sums of (I / g) d, sums of d, sums of d d'] with d the derivatives of log g
    by all coefficients."""
    p, q = len(ar), len(ma)
    turn = np.exp(-1j * angle[:, None] * np.arange(1, max(p, q, 1) + 1))
    phi, theta = 1 - turn[:, :p] @ ar, 1 + turn[:, :q] @ ma
    g = np.abs(theta) ** 2 / np.abs(phi) ** 2
    d = np.concatenate([2 * (turn[:, :p] / phi[:, None]).real, 2 * (turn[:, :q] / theta[:, None]).real], axis=1)
    ratio = power / g
    return np.concatenate([[len(angle), ratio.sum(), np.log(g).sum()], ratio @ d, d.sum(0), (d.T @ d).ravel()])


def log_likelihood(n: int, found: np.ndarray) -> tuple[float, float]:
    """(log-likelihood, variance of the shocks) from sums()."""
    variance = found[1] / found[0]
    return -0.5 * n * (math.log(2 * math.pi * max(variance, 1e-300)) + 1) - found[2], variance


def stable(c: np.ndarray) -> bool:
    """Whether 1 - c1 z - c2 z^2 ... has all roots outside the unit circle."""
    return not len(c) or bool(np.abs(np.roots(np.concatenate([[1.0], -c]))).max() < 0.9999)


def pulled(c: np.ndarray) -> np.ndarray:
    """The coefficients, with roots drawn back geometrically until they are stable."""
    c = np.nan_to_num(np.array(c, float), posinf=0.0, neginf=0.0)
    while not stable(c):
        c = c * 0.9 ** np.arange(1, len(c) + 1)
    return c


class Climb:
    """Scoring steps for one series: hand `at` to sums() and the sums back to take(), until `done`."""

    def __init__(self, n: int, ar, ma):
        self.n, self.p = n, len(ar)
        self.at = np.concatenate([pulled(ar), -pulled(-np.array(ma, float))])
        self.best = self.step = None
        self.value, self.variance, self.rounds, self.done = -math.inf, math.nan, 0, False

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.at[:self.p], self.at[self.p:]

    def take(self, found: np.ndarray) -> None:
        value, variance = log_likelihood(self.n, found)
        self.rounds += 1
        k = len(self.at)
        if value > self.value or self.best is None:
            gain, self.value, self.variance, self.best = value - self.value, value, variance, self.at
            tilt, d, dd = found[3:3 + k], found[3 + k:3 + 2 * k], found[3 + 2 * k:].reshape(k, k)
            score = tilt / max(variance, 1e-300) - d
            self.step = np.linalg.lstsq(dd - np.outer(d, d) / found[0], score, rcond=1e-12)[0] if k else np.zeros(0)
            self.done = not k or gain < TOLERANCE * (1 + abs(value))
        else:
            self.step = self.step / 2
        self.done |= self.rounds >= STEPS or float(np.abs(self.step).max(initial=0)) < 1e-10
        while not self.done and not (stable((self.best + self.step)[:self.p]) and stable(-(self.best + self.step)[self.p:])):
            self.step = self.step / 2
        self.at = self.best if self.done else self.best + self.step


def climb(n: int, ar, ma, evaluate: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Climb:
    run = Climb(n, ar, ma)
    while not run.done:
        run.take(evaluate(*run.parts()))
    return run


def start(values: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """First coefficients, by least squares on lagged values and residuals of a long autoregression."""
    e = values - values.mean()
    reach = long_order(len(e), p, q) + max(p, q) + 2
    products = [float(e[k:] @ e[:len(e) - k]) if k < len(e) else 0.0 for k in range(reach)]
    b, _, _, _ = arma(Lagged(len(e), products, e[:reach + 2], e[-(reach + 2):]), float(values.mean()), p, q)
    return b[1:1 + p], b[1 + p:]


def fit(values: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(AR, MA, variance, log-likelihood) of a series held whole."""
    n = len(values)
    m = frequencies(n)
    power = np.abs(np.fft.rfft(values - values.mean())[1:m + 1]) ** 2 / n
    angle = 2 * np.pi * np.arange(1, m + 1) / n
    done = climb(n, *start(values, p, q), lambda ar, ma: sums(angle, power, ar, ma))
    return done.best[:p], done.best[p:], done.variance, done.value
