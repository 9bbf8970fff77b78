"""Likelihood fits: planted coefficients, sums against a plain formula, long series against short ones, forecasts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsonde.functions import whittle
from tabsonde.operators import timeseries
from tabsonde.plans import neighbours


def simulated(ar, ma, n, seed=1):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 300), np.zeros(n + 300)
    for t in range(3, n + 300):
        y[t] = e[t] + sum(a * y[t - 1 - i] for i, a in enumerate(ar)) + sum(m * e[t - 1 - i] for i, m in enumerate(ma))
    return y[300:] + 7


@pytest.mark.parametrize("ar,ma", [([.6], [.4]), ([], [.5]), ([.5, -.3], []), ([.9], [-.5]), ([], [-.8]), ([], [])])
def test_planted_coefficients(ar, ma):
    y = simulated(ar, ma, 40_000)
    a, m, variance, loglik = whittle.fit(y, len(ar), len(ma))
    assert np.abs(a - ar).max(initial=0) < 0.02 and np.abs(m - ma).max(initial=0) < 0.02
    assert variance == pytest.approx(1.0, abs=0.03)
    # near the exact likelihood of the shocks
    assert loglik == pytest.approx(-0.5 * len(y) * (math.log(2 * math.pi * variance) + 1), abs=2 + 0.001 * len(y))


def test_no_coefficients_nearby_are_likelier():
    y = simulated([.5], [.3], 900)
    a, m, _, best = whittle.fit(y, 1, 1)
    n, k = len(y), whittle.frequencies(len(y))
    power, angle = np.abs(np.fft.rfft(y - y.mean())[1:k + 1]) ** 2 / n, 2 * np.pi * np.arange(1, k + 1) / n
    for da, dm in ((.01, 0), (-.01, 0), (0, .01), (0, -.01), (.01, -.01)):
        assert whittle.log_likelihood(n, whittle.sums(angle, power, a + da, m + dm))[0] < best
    found = whittle.sums(angle, power, a, m)
    g = np.abs(1 + m[0] * np.exp(-1j * angle)) ** 2 / np.abs(1 - a[0] * np.exp(-1j * angle)) ** 2
    assert found[1] == pytest.approx((power / g).sum()) and found[2] == pytest.approx(np.log(g).sum())


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, i, float(v)) for k, y in (("a", simulated([.7], [.2], 260)), (None, simulated([.3], [-.4], 150, 2)),
                                          ("short", np.arange(5.0)), ("flat", np.ones(40))) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, i long, value double").repartition(4)
    return df.select("k", F.timestamp_seconds(F.col("i") * 60).alias("ts"), "value").cache()


def test_spread_fits_equal_whole_ones(frame, monkeypatch):
    whole = {r.k: r for r in timeseries.likelihood_fit(frame, (1, 0, 1), ["k"]).collect()}
    given = {r.k: r for r in timeseries.likelihood(frame, [.5], [.1], ["k"]).collect()}
    assert set(whole) == {"a", None}
    monkeypatch.setattr(neighbours, "TOGETHER", 0)
    monkeypatch.setattr(neighbours, "STRETCH", 64)
    neighbours._rows.clear()
    same = frame.select("*")
    spread = {r.k: r for r in timeseries.likelihood_fit(same, (1, 0, 1), ["k"]).collect()}
    assert set(spread) == set(whole)
    for k, r in spread.items():
        assert r.loglik == pytest.approx(whole[k].loglik, rel=1e-7) and r.variance == pytest.approx(whole[k].variance, rel=1e-5)
        assert r.ar == pytest.approx(whole[k].ar, abs=1e-4) and r.ma == pytest.approx(whole[k].ma, abs=1e-4)
    for r in timeseries.likelihood(same, [.5], [.1], ["k"]).where("n > 10 AND variance > 0").collect():
        if r.k != "flat":
            assert r.loglik == pytest.approx(given[r.k].loglik, rel=1e-8)


def test_forecast(frame):
    got = timeseries.forecast(frame.where("k = 'a'").drop("k"), (1, 0, 1), 4, step="1 minute").orderBy("step").collect()
    fit = timeseries.likelihood_fit(frame.where("k = 'a'").drop("k"), (1, 0, 1)).first()
    steps = np.diff([r.forecast for r in got])
    assert steps[1:] == pytest.approx(steps[:-1] * fit.ar[0], rel=1e-6)  # an AR(1) decay after the first step
    assert got[0].aic == pytest.approx(8 - 2 * fit.loglik) and got[0].bic == pytest.approx(4 * math.log(fit.n) - 2 * fit.loglik)
    assert (got[0].high - got[0].low) == pytest.approx(2 * 1.959963984540054 * math.sqrt(fit.variance))
    assert timeseries.forecast(frame, (1, 1, 1), 2, ["k"]).where("k IN ('short', 'flat')").count() == 0
