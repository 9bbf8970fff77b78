"""Sums of lagged products against regressions on whole arrays."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import yardstick
from tabsonde.functions import lagged
from tabsonde.operators import timeseries


def moments(y, lags):
    e = y - y.mean()
    return lagged.Lagged(len(y), [float(e[k:] @ e[:len(e) - k]) for k in range(lags + 1)], e[:lags + 2], e[-(lags + 2):])


def series(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=n)
    return {"noise": noise + 50, "walk": noise.cumsum() + 1000, "wave": np.sin(np.arange(n) / 3) * 5 + noise * 0.1 + 7}[kind]


@pytest.mark.parametrize("kind", ["noise", "walk", "wave"])
@pytest.mark.parametrize("n", [12, 40, 300])
def test_regressions(kind, n):
    y = series(kind, n, n)
    for max_lag, auto in ((None, True), (0, False), (2, False)):
        lag = lagged.default_adf_lag(n) if max_lag is None else max_lag
        got, want = lagged.adf(moments(y, lag + 1), max_lag, auto), yardstick.adf(y, max_lag, auto)
        assert got[1:] == want[1:] and got[0] == pytest.approx(want[0], rel=1e-6)
    stat, lags = yardstick.kpss(y)
    m = moments(y, n - 2)
    assert lagged.kpss_lag(n, m.c) == lags
    assert lagged.kpss(n, m.c, lags, float((np.cumsum(y - y.mean()) ** 2).sum())) == pytest.approx(stat, rel=1e-9)


@pytest.mark.parametrize("p,q", [(0, 0), (1, 0), (3, 0), (1, 1), (0, 2), (2, 1)])
def test_arma(p, q):
    rng = np.random.default_rng(5)
    shocks = rng.normal(size=600)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.6 * y[t - 1] + shocks[t] + 0.4 * shocks[t - 1]
    y += 30
    got = lagged.arma(moments(y, lagged.long_order(600, p, q) + max(p, q) + 1), y.mean(), p, q)
    b, var, rows = yardstick.arma_fit(y, p, q)
    assert got[0] == pytest.approx(b, rel=1e-6, abs=1e-8) and got[1] == pytest.approx(var, rel=1e-8) and got[2] == rows


@pytest.fixture(scope="module")
def frame(spark):
    day = dt.datetime(2023, 1, 1)
    rows = [(k, day + dt.timedelta(days=i), float(v)) for k, kind, n in (("a", "noise", 200), ("b", "walk", 90), (None, "wave", 120))
            for i, v in enumerate(series(kind, n, 3))]
    rows += [("flat", day + dt.timedelta(days=i), 1.0) for i in range(30)] + [("short", day, 1.0)]
    return spark.createDataFrame(rows, "k string, ts timestamp, value double").repartition(5)


def values(frame):
    out = {}
    for r in frame.orderBy("ts").collect():
        out.setdefault(r.k, []).append(r.value)
    return {k: np.array(v) for k, v in out.items()}


def test_series_by_key(frame):
    own = values(frame)
    adf = {r.k: r for r in timeseries.unit_root_test(frame, ["k"]).collect()}
    kpss = {r.k: r for r in timeseries.stationarity_test(frame, ["k"]).collect()}
    assert set(adf) == set(kpss) == set(own)
    for k in ("a", "b", None):
        t, lags, rows = yardstick.adf(own[k])
        assert (adf[k].lags, adf[k].n) == (lags, rows) and adf[k].statistic == pytest.approx(t, rel=1e-6)
        stat, lags = yardstick.kpss(own[k])
        assert kpss[k].lags == lags and kpss[k].statistic == pytest.approx(stat, rel=1e-8)
        got = timeseries.periodogram(frame, 3, ["k"]).where(F.col("k").eqNullSafe(F.lit(k))).orderBy("rank").collect()
        for r, (f, period, power) in zip(got, yardstick.strongest_periods(own[k], 3), strict=True):
            assert (r.frequency, r.period) == (f, period) and r.power == pytest.approx(power, rel=1e-8)
    assert adf["flat"].statistic is None and kpss["short"].statistic is None


def test_one_series_and_forecast(frame):
    one = frame.where("k = 'b'").select("ts", "value")
    y = values(frame)["b"]
    assert timeseries.unit_root_test(one).first().statistic == pytest.approx(yardstick.adf(y)[0], rel=1e-6)
    for order in ((1, 1, 0), (0, 1, 0), (2, 0, 0), (1, 2, 0)):
        got = timeseries.forecast(one, order, 5, method="least_squares").orderBy("step").collect()
        want = yardstick.arma_forecast(y, *order, 5)
        assert [r.forecast for r in got] == pytest.approx(want["forecast"].tolist(), rel=1e-6)
        assert [r.high - r.forecast for r in got] == pytest.approx((1.959963984540054 * want["se"]).tolist(), rel=1e-5)
        assert got[0].aic == pytest.approx(want["aic"], rel=1e-8)
    close = timeseries.forecast(one, (1, 1, 1), 5).orderBy("step").collect()
    assert close[0].forecast == pytest.approx(yardstick.arma_forecast(y, 1, 1, 1, 5)["forecast"][0], abs=1.0)


def test_periods_and_grains(spark, frame):
    assert timeseries.usual_period(frame.where("k = 'a'")) == 7
    monthly = spark.sql("SELECT add_months(DATE'2020-01-01', CAST(id AS INT))::timestamp AS ts, CAST(id AS DOUBLE) AS value FROM range(30)")
    assert timeseries.usual_period(monthly) == 12 and timeseries.decompose(monthly, None).where("trend IS NOT NULL").count() == 18
    assert timeseries.usual_period(monthly.limit(1)) == 4
    raw = spark.sql("SELECT TIMESTAMP'2020-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id % 100 / 2) AS ts, CAST(id AS DOUBLE) AS v FROM range(300)")
    assert [timeseries.aggregate(raw, "ts", "v", grain=g).count() for g in (None, "second", "minute")] == [100, 50, 1]
