"""Tail probabilities for result rows (one row per test, never per data row).

Regularised incomplete beta and gamma functions by continued fraction and series
(Lentz's method); tails are computed directly, not as 1 - cdf. Columns are computed on whole arrays, in
which rows that have converged stop; the functions of single numbers serve the driver and the tests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.functions.normal import norm_cdf

_TINY = 1e-300
_EPS = 1e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 20000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """I_x(a, b); y = 1 - x may be given to keep digits near x = 1."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log(y))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, y) / b


def gammainc_upper(a: float, x: float) -> float:
    """Q(a, x), the upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 20000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return math.exp(log_front) * h


def _usable(*v) -> bool:
    return all(x is not None and not math.isnan(x) for x in v)


def t_two_sided(t: float, df: float) -> float | None:
    if not _usable(t, df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_upper(t: float, df: float) -> float | None:
    both = t_two_sided(t, df)
    if both is None:
        return None
    return both / 2.0 if t > 0 else 1.0 - both / 2.0


def f_upper(f: float, d1: float, d2: float) -> float | None:
    if not _usable(f, d1, d2) or d1 <= 0 or d2 <= 0:
        return None
    if f <= 0:
        return 1.0
    s = d2 + d1 * f
    return betainc(d2 / 2.0, d1 / 2.0, d2 / s, d1 * f / s)


def chi2_upper(x: float, df: float) -> float | None:
    if not _usable(x, df) or df <= 0:
        return None
    return gammainc_upper(df / 2.0, x / 2.0)


def normal_upper(z: float) -> float | None:
    return 0.5 * math.erfc(z / math.sqrt(2.0)) if _usable(z) else None


def t_ppf(p: float, df: float) -> float | None:
    """Quantile of Student's t by bisection on the upper tail."""
    if not _usable(p, df) or not 0.0 < p < 1.0 or df <= 0:
        return None
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    lo, hi = 0.0, 2.0
    while t_upper(hi, df) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_upper(mid, df) > 1.0 - p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * hi:
            break
    return (lo + hi) / 2.0


def normal_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def kolmogorov_upper(d: float, n: float) -> float | None:
    """P(D_n > d): exact for small n (Marsaglia, Tsang, Wang 2003), else the limit law."""
    if not _usable(d, n) or n < 1:
        return None
    n = int(n)
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n <= 140:
        return max(0.0, 1.0 - _kolmogorov_matrix(d, n))
    x = d * math.sqrt(n)
    x += 1.0 / (6.0 * math.sqrt(n)) + (x - 1.0) / (4.0 * n)  # Vrbik 2018 correction
    if x <= 0:
        return 1.0
    if x < 1.18:
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi ** 2 / (8 * x * x)) for k in range(1, 20))
        return 1.0 - math.sqrt(2 * math.pi) / x * s
    return 2.0 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 40))


def _kolmogorov_matrix(d: float, n: int) -> float:
    k = int(n * d) + 1
    m = 2 * k - 1
    h = k - n * d
    H = np.tril(np.ones((m, m)), 1)
    for i in range(m):
        H[i, 0] -= h ** (i + 1)
        H[m - 1, i] -= h ** (m - i)
    H[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                H[i, j] /= math.factorial(i - j + 1)
    Q = np.linalg.matrix_power(H, n)
    s = Q[k - 1, k - 1]
    for i in range(1, n + 1):
        s *= i / n
    return float(s)


# ---- whole arrays ------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers: Stirling's series from 10 on, steps up to there."""
    y, steps = np.array(x, float), np.zeros(len(x))
    for _ in range(10):
        low = y < 10
        steps += np.where(low, np.log(np.where(low, y, 1.0)), 0.0)
        y = y + low
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def _away_from_zero(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) > _TINY, v, _TINY)


def _beta_fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(x)), np.arange(len(x))
    c, d = np.ones(len(x)), 1.0 / _away_from_zero(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 20000):
        if not len(at):
            break
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / _away_from_zero(1.0 + num * d)
            c = _away_from_zero(1.0 + num / c)
            h = h * d * c
        open_ = ~(np.abs(d * c - 1.0) < _EPS)
        out[at] = h
        at, a, b, x, c, d, h = (v[open_] for v in (at, a, b, x, c, d, h))
    return out


def beta_upper(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I_x(a, b) with y = 1 - x, of arrays."""
    with np.errstate(all="ignore"):
        inside = (x > 0) & (y > 0)
        x1, y1 = np.where(inside, x, 0.5), np.where(inside, y, 0.5)
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x1) + b * np.log(y1))
        direct = x1 < (a + 1.0) / (a + b + 2.0)
        p, q, z = np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x1, y1)
        part = front * _beta_fractions(p, q, z) / p
        return np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, np.where(direct, part, 1.0 - part)))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x) of arrays."""
    with np.errstate(all="ignore"):
        out = np.ones(len(x))
        front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - _log_gamma(a))
        at = np.flatnonzero((x > 0) & (x < a + 1.0))
        k, y = a[at].copy(), x[at]
        term = total = 1.0 / k
        while len(at):
            out[at] = np.maximum(0.0, 1.0 - total * front[at])
            open_ = np.abs(term) > np.abs(total) * _EPS
            at, k, y, term, total = (v[open_] for v in (at, k, y, term, total))
            k = k + 1.0
            term = term * y / k
            total = total + term
        at = np.flatnonzero(x >= a + 1.0)
        own, b = a[at], x[at] + 1.0 - a[at]
        c, d = np.full(len(at), 1.0 / _TINY), 1.0 / b
        h = d.copy()
        for i in range(1, 20000):
            if not len(at):
                break
            step = -i * (i - own)
            b = b + 2.0
            d = 1.0 / _away_from_zero(step * d + b)
            c = _away_from_zero(b + step / c)
            h = h * d * c
            out[at] = front[at] * h
            open_ = ~(np.abs(d * c - 1.0) < _EPS)
            at, own, b, c, d, h = (v[open_] for v in (at, own, b, c, d, h))
        return out


def t_two_sided_of(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        square = t * t
        p = beta_upper(df / 2.0, np.full(len(df), 0.5), df / (df + square), np.where(np.isinf(t), 1.0, square / (df + square)))
    return np.where(np.isinf(t), 0.0, p)


def t_upper_of(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    both = t_two_sided_of(t, df)
    return np.where(t > 0, both / 2.0, 1.0 - both / 2.0)


def t_ppf_of(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Quantiles by bisection on the upper tail, all rows at once."""
    tail = np.where(p < 0.5, p, 1.0 - p)
    low, high = np.zeros(len(p)), np.full(len(p), 2.0)
    while (more := t_upper_of(high, df) > tail).any():
        high = np.where(more, high * 2.0, high)
    for _ in range(200):
        middle = (low + high) / 2.0
        above = t_upper_of(middle, df) > tail
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        if (high - low <= 1e-15 * high).all():
            break
    return np.where(p < 0.5, -1.0, 1.0) * (low + high) / 2.0


def f_upper_of(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    s = d2 + d1 * np.maximum(f, 0.0)
    return np.where(f <= 0, 1.0, beta_upper(d2 / 2.0, d1 / 2.0, d2 / s, d1 * np.maximum(f, 0.0) / s))


def chi2_upper_of(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_upper(df / 2.0, x / 2.0)


def kolmogorov_upper_of(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The limit law on whole arrays; sizes up to 140 one by one, as each takes powers of a matrix of its own."""
    out = np.array([kolmogorov_upper(a, b) if b <= 140 else np.nan for a, b in zip(d, n)], float)
    long = np.flatnonzero(n > 140)
    x = d[long] * np.sqrt(np.floor(n[long]))
    x = x + 1.0 / (6.0 * np.sqrt(np.floor(n[long]))) + (x - 1.0) / (4.0 * np.floor(n[long]))
    with np.errstate(all="ignore"):
        k = np.arange(1, 40)[:, None]
        small = 1.0 - math.sqrt(2 * math.pi) / x * np.exp(-((2 * k[:19] - 1) ** 2) * math.pi ** 2 / (8 * x * x)).sum(0)
        large = 2.0 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum(0)
    value = np.where(x <= 0, 1.0, np.where(x < 1.18, small, large))
    out[long] = np.where(d[long] <= 0, 1.0, np.where(d[long] >= 1, 0.0, value))
    return out


def _array_udf(fn, valid):
    """A Pandas UDF over result rows; rows that are not `valid`, or have a null, give null."""
    def on_arrays(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(float) for c in columns]
        with np.errstate(all="ignore"):
            fine = np.logical_and.reduce([~np.isnan(v) for v in values]) & valid(*values)
        out = np.full(len(fine), np.nan)
        if fine.any():
            out[fine] = fn(*(v[fine] for v in values))
        return pd.Series(out)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return on_arrays(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return on_arrays(a, b, c)

    udfs = {2: F.pandas_udf(two, T.DoubleType()), 3: F.pandas_udf(three, T.DoubleType())}

    def call(*cols):
        got = udfs[len(cols)](*[c.cast("double") for c in cols])
        return F.when(~F.isnan(got), got)
    return call


t_two_sided_col = _array_udf(t_two_sided_of, lambda t, df: df > 0)
t_upper_col = _array_udf(t_upper_of, lambda t, df: df > 0)
t_ppf_col = _array_udf(t_ppf_of, lambda p, df: (p > 0) & (p < 1) & (df > 0))
f_upper_col = _array_udf(f_upper_of, lambda f, d1, d2: (d1 > 0) & (d2 > 0))
chi2_upper_col = _array_udf(chi2_upper_of, lambda x, df: df > 0)
kolmogorov_upper_col = _array_udf(kolmogorov_upper_of, lambda d, n: n >= 1)


def normal_upper_col(z):
    """P(Z > z) as a column expression."""
    return F.when(z.isNotNull() & ~F.isnan(z), norm_cdf(-z))
