"""Regressions of a series on its own past, from sums of lagged products.

For centred values e_0 .. e_(n-1) the sums C(m) = sum e_u e_(u-m), and the first and last few values, give every
sum of products e_(t-a) e_(t-b) over t = start .. n-1. All regressions on lagged values, lagged differences and
lagged residuals of a long autoregression are linear in those. So a series of any length is reduced to a number
of values that grows with the lags alone.
"""

from __future__ import annotations

import math

import numpy as np

# MacKinnon (1994) p-value surface for a unit root with constant, and the
# critical points of the level stationarity test with their probabilities.
ADF_SMALL = [2.1659, 1.4412, 0.038269]
ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
KPSS_CRITICAL = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]


def adf_p_value(t: float) -> float:
    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    c = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    z = sum(k * t ** i for i, k in enumerate(c))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def kpss_p_value(stat: float) -> float:
    return float(np.interp(stat, KPSS_CRITICAL, KPSS_P))


class Lagged:
    """Moments of one centred series: n, C(0) .. C(L), and its first and last values (L + 2 at least, or all)."""

    def __init__(self, n: int, products, head, tail):
        self.n, self.c = n, np.asarray(products, float)
        self.head, self.tail = np.asarray(head, float), np.asarray(tail, float)

    def _at(self, u: int) -> float:
        return self.head[u] if u < len(self.head) else self.tail[u - (self.n - len(self.tail))]

    def gram(self, lags: int, start: int) -> np.ndarray:
        """Products of e_t, e_(t-1) .. e_(t-lags), 1 summed over t = start .. n-1."""
        out = np.empty((lags + 2, lags + 2))
        for a in range(lags + 1):
            for b in range(a, lags + 1):
                m = b - a
                early = sum(self._at(u) * self._at(u - m) for u in range(m, start - a))
                late = sum(self._at(u) * self._at(u - m) for u in range(self.n - a, self.n))
                out[a, b] = out[b, a] = self.c[m] - early - late
            out[a, -1] = out[-1, a] = -sum(map(self._at, range(start - a))) - sum(map(self._at, range(self.n - a, self.n)))
        out[-1, -1] = self.n - start
        return out


def _regress(gram: np.ndarray, columns: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse of X'X of a regression whose columns and target are
    combinations of the variables of the Gram matrix."""
    xx, xy = columns @ gram @ columns.T, columns @ gram @ target
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inverse = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
    b = inverse @ xy
    return b, max(float(target @ gram @ target - b @ xy), 0.0), inverse


def default_adf_lag(n: int) -> int:
    return max(0, min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2))


def adf(series: Lagged, max_lag: int | None = None, auto: bool = True) -> tuple[float, int, int]:
    """(t statistic, lags, rows) of the unit root regression with constant."""
    limit = default_adf_lag(series.n) if max_lag is None else max_lag

    def fit(lags: int, start: int) -> tuple[np.ndarray, float, np.ndarray, int]:
        size = lags + 3  # e_t .. e_(t-lags-1), 1
        unit = np.eye(size)
        change = [unit[k] - unit[k + 1] for k in range(lags + 1)]
        return *_regress(series.gram(lags + 1, start + 1), np.array([unit[1], *change[1:], unit[-1]]), change[0]), series.n - start - 1

    lags = limit
    if auto:
        best = math.inf
        for k in range(limit + 1):
            b, rss, _, rows = fit(k, limit)
            aic = rows * (math.log(2 * math.pi * max(rss, 1e-300) / rows) + 1) + 2 * len(b)
            if aic < best:
                best, lags = aic, k
    b, rss, inverse, rows = fit(lags, lags)
    return float(b[0] / math.sqrt(rss / (rows - len(b)) * inverse[0, 0])), lags, rows


def kpss_lag(n: int, products) -> int:
    """Automatic lag from autocovariances up to n ** (2 / 9)."""
    cov = np.asarray(products, float) / n
    k = np.arange(1, int(n ** (2.0 / 9.0)) + 1)
    s0, s1 = cov[0] + 2 * cov[k].sum(), 2 * (k * cov[k]).sum()
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1)


def kpss(n: int, products, lags: int, squared_sums: float) -> float:
    """Statistic of level stationarity; `squared_sums` are the squares of the running sums, added up."""
    cov = np.asarray(products, float) / n
    k = np.arange(1, lags + 1)
    return float(squared_sums / (n * n * (cov[0] + 2 * ((1 - k / (lags + 1.0)) * cov[k]).sum())))


def long_order(n: int, p: int, q: int) -> int:
    """Order of the autoregression whose residuals stand in for the shocks."""
    return min(max(p, q) + 1 if n < 2 else max(max(p, q) + 1, int(math.ceil(10 * math.log10(n)))), max(1, (n - 1) // 3)) if q else 0


def arma(series: Lagged, mean: float, p: int, q: int) -> tuple[np.ndarray, float, int, np.ndarray]:
    """(constant, AR, MA coefficients), residual variance, rows, last q residuals (newest last), after Hannan and
    Rissanen."""
    long, m = long_order(series.n, p, q), max(p, q)
    reach = long + m
    unit = np.eye(reach + 2)
    shock = np.zeros(reach + 2)
    if q:
        own = np.eye(long + 2)
        phi, _, _ = _regress(series.gram(long, long), np.array([own[-1], *own[1:long + 1]]), own[0])
        shock[0], shock[1:long + 1], shock[-1] = 1.0, -phi[1:], -phi[0]

    def moved(k: int) -> np.ndarray:
        """The residual k steps back, in e_t .. e_(t-reach), 1."""
        out = np.zeros(reach + 2)
        out[k:k + long + 1] = shock[:long + 1]
        out[-1] = shock[-1]
        return out

    columns = np.array([unit[-1], *unit[1:p + 1], *[moved(k) for k in range(1, q + 1)]])
    b, rss, _ = _regress(series.gram(reach, reach), columns, unit[0])
    rows = series.n - reach
    b = b.copy()
    b[0] += mean * (1 - b[1:1 + p].sum())
    last = [float(shock[:long + 1] @ [series._at(series.n - 1 - k - j) for j in range(long + 1)] + shock[-1])
            for k in range(q)][::-1]
    return b, rss / max(1, rows), rows, np.array(last)


def forecast(series: Lagged, mean: float, last_values, p: int, d: int, q: int, steps: int, fitted=None) -> dict:
    """Forecast of an ARIMA(p, d, q) whose d-th difference has these moments; `last_values` are the last d values
    before differencing (newest last). `fitted` has (AR, MA, variance, log-likelihood) found otherwise."""
    b, var, rows, errors = arma(series, mean, p, q)
    loglik = -0.5 * rows * (math.log(2 * math.pi * max(var, 1e-300)) + 1)
    if fitted is not None:
        ar, ma, var, loglik = fitted
        b, rows = np.concatenate([[mean * (1 - np.sum(ar))], ar, ma]), series.n
    const, ar, ma = b[0], b[1:1 + p], b[1 + p:]
    hist = [mean + series._at(series.n - k) for k in range(p, 0, -1)]
    err, out = list(errors), []
    for _ in range(steps):
        f = const + sum(a * v for a, v in zip(ar, hist[::-1])) + sum(c * v for c, v in zip(ma, err[::-1]))
        out.append(f)
        hist = (hist + [f])[-p:] if p else []
        err = (err + [0.0])[-q:] if q else []
    psi = [1.0]
    for j in range(1, steps):
        psi.append((ma[j - 1] if j <= q else 0.0) + sum(ar[i] * psi[j - 1 - i] for i in range(min(p, j))))
    f, psi = np.array(out), np.array(psi)
    for k in range(d):
        f = np.cumsum(f) + np.diff(np.asarray(last_values, float), d - 1 - k)[-1]
        psi = np.cumsum(psi)
    k = p + q + 2
    return {"forecast": f, "se": np.sqrt(var * np.cumsum(psi ** 2)), "aic": 2 * k - 2 * loglik,
            "bic": k * math.log(rows) - 2 * loglik, "coefficients": b}
