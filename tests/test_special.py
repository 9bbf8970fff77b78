"""Distribution functions against table values and the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import yardstick
from tabsonde.functions import lagged, special
from tabsonde.functions.normal import norm_cdf, norm_log_cdf, norm_ppf


@pytest.mark.parametrize("t,df,p", [(2.228138852, 10, 0.05), (12.7062047364, 1, 0.05), (2.575829304, 1e9, 0.01),
                                    (3.169272673, 10, 0.01), (0.0, 5, 1.0)])
def test_t(t, df, p):
    assert special.t_two_sided(t, df) == pytest.approx(p, rel=1e-6)
    assert special.t_two_sided(-t, df) == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize("f,a,b,p", [(4.964602744, 1, 10, 0.05), (3.098391221, 3, 20, 0.05), (5.952544683, 2, 15, 0.0124938)])
def test_f(f, a, b, p):
    assert special.f_upper(f, a, b) == pytest.approx(p, rel=1e-3)


@pytest.mark.parametrize("x,df,p", [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (18.30703805, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2(x, df, p):
    assert special.chi2_upper(x, df) == pytest.approx(p, rel=1e-7)


def test_tails_keep_digits():
    assert special.t_two_sided(40.0, 1e6) == pytest.approx(2 * special.normal_upper(40.0), rel=0.5)
    assert 0 < special.f_upper(2000.0, 1, 1000) < 1e-200
    assert special.chi2_upper(1400.0, 2) == pytest.approx(math.exp(-700.0), rel=1e-9)


def test_t_squared_is_f():
    assert special.t_two_sided(2.5, 17) == pytest.approx(special.f_upper(6.25, 1, 17), rel=1e-12)


def test_quantiles():
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228138852, rel=1e-9)
    assert special.t_ppf(0.025, 10) == pytest.approx(-2.228138852, rel=1e-9)
    assert special.normal_ppf(0.975) == pytest.approx(1.959963984540054, rel=1e-12)


def test_kolmogorov():
    assert special.kolmogorov_upper(0.274, 10) == pytest.approx(0.3715, abs=2e-3)
    assert special.kolmogorov_upper(1.3581 / math.sqrt(1e6), 1e6) == pytest.approx(0.05, abs=5e-4)
    assert special.kolmogorov_upper(0.0, 5) == 1.0
    assert special.kolmogorov_upper(1.0, 5) == 0.0


def test_missing_input_gives_none():
    assert special.t_two_sided(None, 3) is None
    assert special.f_upper(1.0, 0, 3) is None
    assert special.chi2_upper(float("nan"), 2) is None


@settings(max_examples=200, deadline=None)
@given(st.floats(-8, 8), st.floats(1, 500))
def test_t_is_symmetric_and_bounded(t, df):
    p = special.t_upper(t, df)
    assert 0.0 <= p <= 1.0
    assert p + special.t_upper(-t, df) == pytest.approx(1.0, abs=1e-12)


def test_normal_columns(spark):
    zs = [-38.0, -20.0, -13.0, -9.0, -3.0, -0.5, 0.0, 0.3, 1.0, 4.0, 6.5, 9.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(
        "z", norm_cdf(F.col("z")).alias("c"), norm_log_cdf(F.col("z")).alias("l")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert r.c == pytest.approx(want, rel=1e-6 if r.z < -7 else 1e-12, abs=1e-300)
        assert r.l == pytest.approx(math.log(want) if want > 0 else r.l, rel=1e-7, abs=1e-15)
        assert math.isfinite(r.l)
    ps = [1e-300, 1e-12, 0.001, 0.07, 0.3, 0.5, 0.8, 0.975, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", norm_ppf(F.col("p")).alias("q")).collect()
    for r in got:
        assert r.q == pytest.approx(special.normal_ppf(r.p) if r.p < 1e-15 else NormalDist().inv_cdf(r.p), rel=1e-9, abs=1e-12)
    edge = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(norm_ppf(F.col("p")).alias("q")).collect()
    assert [r.q for r in edge] == [None, None]


def test_adf_surface():
    assert lagged.adf_p_value(-2.86) == pytest.approx(0.050, abs=1e-3)
    assert lagged.adf_p_value(-1.61 - 1e-9) == pytest.approx(lagged.adf_p_value(-1.61 + 1e-9), abs=2e-3)
    assert (lagged.adf_p_value(5.0), lagged.adf_p_value(-30.0)) == (1.0, 0.0)


def test_adf_and_kpss_tell_walk_from_noise():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=800)
    walk = np.cumsum(noise)
    assert lagged.adf_p_value(yardstick.adf(noise)[0]) < 0.01
    assert lagged.adf_p_value(yardstick.adf(walk)[0]) > 0.05
    assert yardstick.kpss(noise)[0] < 0.463 < yardstick.kpss(walk)[0]


def test_arma_recovers_planted_coefficients():
    rng = np.random.default_rng(3)
    e = rng.normal(size=20000)
    y = np.zeros(20000)
    for t in range(1, 20000):
        y[t] = 1.0 + 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    b, var, _ = yardstick.arma_fit(y, 1, 1)
    assert b[1] == pytest.approx(0.6, abs=0.03) and b[2] == pytest.approx(0.3, abs=0.03)
    assert var == pytest.approx(1.0, abs=0.05)


def test_forecast_of_a_line_goes_on():
    got = yardstick.arma_forecast(np.arange(60.0) * 2 + 5, 0, 1, 0, 3)
    assert got["forecast"] == pytest.approx([125.0, 127.0, 129.0])
    assert yardstick.strongest_periods(np.sin(2 * np.pi * np.arange(240) / 12), 1)[0][1] == pytest.approx(12.0)


def test_arrays_equal_single_numbers():
    """Every tail on whole arrays against the functions of single numbers, over sizes, tails and edges."""
    rng = np.random.default_rng(4)
    n = 3000
    t, df = rng.normal(size=n) * rng.choice([0.1, 1, 5, 40], n), rng.choice([1, 2, 3.5, 10, 120, 5000, 1e6], n)
    t[:4] = [0.0, np.inf, -np.inf, 1e-9]
    same = lambda got, want: np.testing.assert_allclose(got, np.array(want, float), rtol=1e-6, atol=1e-300)
    same(special.t_two_sided_of(t, df), [special.t_two_sided(*v) for v in zip(t, df)])
    same(special.t_upper_of(t, df), [special.t_upper(*v) for v in zip(t, df)])
    f, d1, d2 = np.abs(t[4:]) * 3, rng.choice([1, 2, 7, 400], n - 4).astype(float), rng.choice([1, 5, 30, 1e5], n - 4)
    f[:2] = [0.0, -1.0]
    same(special.f_upper_of(f, d1, d2), [special.f_upper(*v) for v in zip(f, d1, d2)])
    x = f * d1
    same(special.chi2_upper_of(x, d1), [special.chi2_upper(*v) for v in zip(x, d1)])
    d, sizes = rng.random(400) ** 3, rng.choice([1, 20, 141, 900, 10 ** 6], 400).astype(float)
    d[:2] = [0.0, 1.0]
    np.testing.assert_allclose(special.kolmogorov_upper_of(d, sizes), [special.kolmogorov_upper(*v) for v in zip(d, sizes)], rtol=1e-9, atol=1e-14)
    p = rng.random(60)
    np.testing.assert_allclose(special.t_ppf_of(p, df[:60]), [special.t_ppf(*v) for v in zip(p, df[:60])], rtol=1e-7, atol=1e-12)
    lg = np.concatenate([rng.random(200) * 30 + 1e-3, [0.5, 1, 2, 10, 1e7]])
    np.testing.assert_allclose(special._log_gamma(lg), [math.lgamma(v) for v in lg], rtol=1e-13, atol=1e-13)


def test_columns_of_tails(spark):
    rows = [(1.5, 10.0), (None, 3.0), (2.0, 0.0), (float("nan"), 4.0), (float("inf"), 4.0)]
    df = spark.createDataFrame(rows, "t double, df double")
    got = [r[0] for r in df.select(special.t_two_sided_col(F.col("t"), F.col("df"))).collect()]
    assert got[0] == pytest.approx(special.t_two_sided(1.5, 10.0)) and got[1:4] == [None] * 3 and got[4] == 0.0
    assert df.limit(0).select(special.f_upper_col(F.col("t"), F.col("df"), F.col("df"))).count() == 0
