"""Series that no task holds whole give the same results as short ones, and their plans have no window over all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import yardstick
from tabsonde.functions import fourier
from tabsonde.operators import timeseries
from tabsonde.plans import neighbours


@pytest.fixture
def long(monkeypatch):
    monkeypatch.setattr(neighbours, "TOGETHER", 0)
    monkeypatch.setattr(neighbours, "STRETCH", 32)
    monkeypatch.setattr(timeseries, "STRETCH", 32)


@pytest.fixture(scope="module")
def frame(spark):
    """Raw stamps of three series, one with a null key."""
    rng = np.random.default_rng(6)
    rows = [(k, i, float(v)) for k, n in (("a", 300), ("b", 77), (None, 150), ("one", 1))
            for i, v in enumerate(rng.normal(size=n).cumsum() + 5 * np.sin(np.arange(n) / 4) + 40)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(7)
    return df.select("k", F.timestamp_seconds(F.col("i") * 7 + F.col("i") % 3).alias("t"), "v")


CALLS = {
    "decompose": lambda s, by: timeseries.decompose(s, 4, by=by),
    "decompose odd": lambda s, by: timeseries.decompose(s, 9, "multiplicative", by),
    "seasonal means": lambda s, by: timeseries.seasonal_means(s, 5, by),
    "change": lambda s, by: timeseries.percent_change(s, by),
    "adf": lambda s, by: timeseries.unit_root_test(s, by).drop("p_value"),
    "kpss": lambda s, by: timeseries.stationarity_test(s, by),
    "periods": lambda s, by: timeseries.periodogram(s, 4, by),
    "forecast": lambda s, by: timeseries.forecast(s, (1, 1, 0), 3, by, "7 seconds"),
    "trend": lambda s, by: timeseries.trend(s, by).drop("p_value"),
}


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def whole(frame):
    series = timeseries.aggregate(frame, "t", "v", ["k"], None)
    return {name: rows(call(series, ["k"])) for name, call in CALLS.items()}


@pytest.mark.parametrize("name", list(CALLS))
def test_same_results(frame, whole, long, name):
    got = rows(CALLS[name](timeseries.aggregate(frame, "t", "v", ["k"], None), ["k"]))
    assert len(got) == len(whole[name])
    for a, b in zip(got, whole[name]):
        for u, v in zip(a, b, strict=True):
            assert u == pytest.approx(v, rel=1e-6, abs=1e-5) if isinstance(v, float) else u == v


def test_one_series_without_keys(frame, long):
    s = timeseries.aggregate(frame.where("k = 'a'"), "t", "v", grain=None)
    assert timeseries.usual_period(s) == 4
    y = np.array([r.value for r in s.orderBy("ts").collect()])
    got = timeseries.periodogram(s, 3).orderBy("rank").collect()
    assert [r.frequency for r in got] == [f for f, _, _ in yardstick.strongest_periods(y, 3)]
    assert timeseries.stationarity_test(s).first().statistic == pytest.approx(yardstick.kpss(y)[0], rel=1e-8)


def test_a_million_stamps(spark):
    """Changes and the periodogram of 2**20 + 7 stamps, spread over many tasks."""
    n = neighbours.TOGETHER + 7
    raw = spark.range(n).select(F.timestamp_micros(F.col("id") * 1000).alias("t"),
                                (10 + F.sin(F.col("id") * (2 * np.pi * 1234 / n)) + (F.col("id") % 17) * 0.01).alias("v"))
    s = timeseries.aggregate(raw, "t", "v", grain=None)
    change = timeseries.percent_change(s)
    plan = change._jdf.queryExecution().optimizedPlan().toString()
    assert "_stretch" in plan and "windowspecdefinition(ts" not in plan
    per_task = change.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    assert per_task[0] < n / 3 and per_task[1] > 3
    x = np.arange(n)
    v = 10 + np.sin(x * (2 * np.pi * 1234 / n)) + (x % 17) * 0.01
    total = change.agg(F.sum("change"), F.count("change")).first()
    assert total[1] == n - 1 and total[0] == pytest.approx((np.diff(v) / v[:-1]).sum(), abs=1e-6)
    got = timeseries.periodogram(s, 2).orderBy("rank").collect()
    want = fourier.strongest(v, 2)
    assert [r.frequency for r in got] == want[0].tolist() and got[0].power == pytest.approx(want[1][0], rel=1e-6)


@pytest.mark.parametrize("n", [2, 3, 5, 16, 97, 1000])
def test_chirp(n):
    """The pieces of the transform on arrays: chirps, sides and twiddles against NumPy's transform."""
    rng = np.random.default_rng(n)
    x, j = rng.normal(size=n), np.arange(n)
    length = fourier.power_of_two(n)
    columns, lines = fourier.sides(length)
    assert length >= 2 * n - 1 and columns * lines == length

    def four_steps(v):
        m = fourier.first_side(v.reshape(columns, lines).T, np.arange(lines), length)
        return np.fft.fft(m.T, axis=1).T.ravel()
    a, b = np.zeros(length, complex), np.zeros(length, complex)
    w = fourier.chirp(j, n)
    a[:n], b[:n] = x * w, np.conj(w)
    b[length - j[1:]] = np.conj(w[1:])
    assert np.allclose(four_steps(a), np.fft.fft(a))
    back = np.conj(four_steps(np.conj(four_steps(a) * four_steps(b)))) / length
    assert np.allclose(back[:n] * w, np.fft.fft(x))
