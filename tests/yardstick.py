"""Unit root, stationarity, spectrum and ARMA computed from whole arrays: yardsticks for the distributed versions."""

from __future__ import annotations

import math

import numpy as np


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and the diagonal of (X'X)^-1."""
    q, r = np.linalg.qr(x)
    b = np.linalg.solve(r, q.T @ y)
    e = y - x @ b
    inv = np.linalg.inv(r)
    return b, float(e @ e), np.sum(inv * inv, axis=1)


def adf(y: np.ndarray, max_lag: int | None = None, auto: bool = True) -> tuple[float, int, int]:
    """(t statistic, lags, rows) of the unit root regression with constant."""
    n = len(y)
    if max_lag is None:
        max_lag = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    d = np.diff(y)

    def design(lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        cols = [y[start:-1]] + [d[start - k:len(d) - k] for k in range(1, lags + 1)]
        return np.column_stack([*cols, np.ones(len(d) - start)]), d[start:]

    lags = max_lag
    if auto:
        best = math.inf
        for k in range(max_lag + 1):
            x, t = design(k, max_lag)
            rss = max(least_squares(x, t)[1], 1e-300)
            aic = len(t) * (math.log(2 * math.pi * rss / len(t)) + 1) + 2 * x.shape[1]
            if aic < best:
                best, lags = aic, k
    x, t = design(lags, lags)
    b, rss, inv = least_squares(x, t)
    se = math.sqrt(rss / (len(t) - x.shape[1]) * inv[0])
    return float(b[0] / se), lags, len(t)


def kpss(y: np.ndarray) -> tuple[float, int]:
    """(statistic, lags) of the level stationarity test with automatic lag."""
    n = len(y)
    e = y - y.mean()
    cov = lambda k: float(e[k:] @ e[:n - k]) / n
    limit = int(n ** (2.0 / 9.0))
    s0 = cov(0) + 2 * sum(cov(k) for k in range(1, limit + 1))
    s1 = 2 * sum(k * cov(k) for k in range(1, limit + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1)
    var = cov(0) + 2 * sum((1 - k / (lags + 1.0)) * cov(k) for k in range(1, lags + 1))
    return float(np.sum(np.cumsum(e) ** 2) / (n * n * var)), lags


def strongest_periods(y: np.ndarray, top: int) -> list[tuple[int, float, float]]:
    """(frequency index, period, power) of the strongest positive frequencies."""
    power = np.abs(np.fft.rfft(y - y.mean())) ** 2
    order = np.argsort(-power[1:], kind="stable")[:top] + 1
    return [(int(k), len(y) / float(k), float(power[k])) for k in order]


def arma_fit(w: np.ndarray, p: int, q: int) -> tuple[np.ndarray, float, int]:
    """(constant, AR, MA coefficients), residual variance and rows: a long autoregression
    gives residuals, then w is regressed on its own lags and theirs."""
    n = len(w)
    m = max(p, q)
    e, first = np.zeros(n), 0
    if q:
        long = min(max(m + 1, int(math.ceil(10 * math.log10(max(n, 2))))), max(1, (n - 1) // 3))
        x = np.column_stack([np.ones(n - long)] + [w[long - k:n - k] for k in range(1, long + 1)])
        e[long:] = w[long:] - x @ np.linalg.lstsq(x, w[long:], rcond=None)[0]
        first = long
    start = first + m
    x = np.column_stack([np.ones(n - start)] + [w[start - k:n - k] for k in range(1, p + 1)]
                        + [e[start - k:n - k] for k in range(1, q + 1)])
    b = np.linalg.lstsq(x, w[start:], rcond=None)[0]
    r = w[start:] - x @ b
    return b, float(r @ r) / max(1, len(r)), len(r)


def arma_forecast(y: np.ndarray, p: int, d: int, q: int, steps: int) -> dict:
    """Forecast of an ARIMA(p, d, q) by conditional least squares with its standard errors."""
    w = np.diff(y, d) if d else y
    b, var, rows = arma_fit(w, p, q)
    const, ar, ma = b[0], b[1:1 + p], b[1 + p:]
    e = np.zeros(len(w))
    for t in range(max(p, q), len(w)):
        e[t] = w[t] - const - ar @ w[t - p:t][::-1] - (ma @ e[t - q:t][::-1] if q else 0.0)
    hist, err = list(w[len(w) - p:]) if p else [], list(e[len(e) - q:]) if q else []
    out = []
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
        f = np.cumsum(f) + np.diff(y, d - 1 - k)[-1]
        psi = np.cumsum(psi)
    k = p + q + 2
    loglik = -0.5 * rows * (math.log(2 * math.pi * max(var, 1e-300)) + 1)
    return {"forecast": f, "se": np.sqrt(var * np.cumsum(psi ** 2)), "aic": 2 * k - 2 * loglik,
            "bic": k * math.log(rows) - 2 * loglik, "coefficients": b}
