"""Time series: aggregation, decomposition, stationarity, periods, trend and forecast.

Every analysis starts from `aggregate`, which reduces a table to one row per series and time
step. With calendar steps of a day or more a series stays small however many rows the table has; with
seconds or raw time stamps it grows with the table. What fits in one task is windowed there, and longer
series are cut into stretches that know their neighbours (plans.neighbours). Tests and forecasts need sums
of lagged products, which are joined and added up by Spark, and the periodogram, which is a Fourier
transform in one task or spread over all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabsonde.functions import fourier, lagged, whittle
from tabsonde.operators.correlation import r_p_value
from tabsonde.plans.aggregates import pair_sums, pearson
from tabsonde.plans.neighbours import STRETCH, fits, framed, known_rows, numbered, short
from tabsonde.schema import as_double, require_columns, require_numeric

GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
MIN_TREND, MIN_SEASONAL, TREND_PERIOD = 10, 24, 12


def aggregate(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), grain: str | None = "day") -> DataFrame:
    """(by, ts, value): mean per time step, or per time stamp as it is without a grain."""
    require_columns(df, [ts, *by])
    require_numeric(df, [value])
    if grain is not None and grain not in GRAINS:
        raise ValueError(f"grain is None or one of {GRAINS}")
    v = as_double(value)
    step = F.date_trunc(grain, F.col(ts)).cast(df.schema[ts].dataType) if grain else F.col(ts)
    out = (df.where(F.col(ts).isNotNull() & v.isNotNull()).groupBy(*by, step.alias("ts"))
           .agg(F.avg(v).alias("value")))
    return short(out) if grain in GRAINS[3:] else out


def line(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), grain: str = "day") -> DataFrame:
    """The points of a line chart in time order."""
    return aggregate(df, ts, value, by, grain).orderBy(*by, "ts")


def positions(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number the steps of each series from 0."""
    return numbered(series, by, "ts")


def _run(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def usual_period(series: DataFrame, by: Sequence[str] = ()) -> int:
    """7 for daily steps, 12 for monthly ones, else 4, by the commonest step."""
    x = framed(positions(series, by), by, 1, lambda w: {"d": F.datediff("ts", F.lag("ts").over(w))})
    days = x.agg(F.mode("d", True)).first()[0]
    return 7 if days == 1 else 12 if days is not None and 28 <= days <= 31 else 4


def decompose(series: DataFrame, period: int | None = 4, model: str = "additive", by: Sequence[str] = ()) -> DataFrame:
    """(by, ts, pos, value, trend, seasonal, residual) by moving averages.

    Without a period, the usual one of the steps is taken.
    The trend is a centred mean over one period (half weight at both ends when even) and null
    where the window is incomplete; the seasonal part is the centred mean per phase.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError("model is 'additive' or 'multiplicative'")
    add = model == "additive"
    period = period or usual_period(series, by)
    k = period // 2

    def trend(w) -> dict[str, Column]:
        full = w.rowsBetween(-k, k)
        total = F.sum("value").over(full)
        if period % 2 == 0:
            total = total - (F.lag("value", k).over(w) + F.lead("value", k).over(w)) / 2
        return {"trend": F.when(F.count("value").over(full) == 2 * k + 1, total / period)}

    x = framed(positions(series, by), by, k, trend).withColumn("phase", F.pmod("pos", F.lit(period)))
    x = x.withColumn("detrended", F.col("value") - F.col("trend") if add
                     else F.try_divide("value", "trend"))
    # One row per phase; the phases of a series are averaged without weights.
    phases = x.groupBy(*by, "phase").agg(F.avg("detrended").alias("m"))
    centre = _run(phases, by, [F.avg("m").alias("c")])
    joined = phases.join(F.broadcast(centre), list(by)) if by else phases.crossJoin(F.broadcast(centre))
    seasonal = joined.select(*by, "phase", (F.col("m") - F.col("c") if add else F.try_divide("m", "c")).alias("seasonal"))
    out = x.join(seasonal, [*by, "phase"])
    rest = (F.col("value") - F.col("trend") - F.col("seasonal") if add
            else F.try_divide(F.col("value"), F.col("trend") * F.col("seasonal")))
    return out.select(*by, "ts", "pos", "value", "trend", "seasonal", rest.alias("residual"))


def seasonal_means(series: DataFrame, period: int, by: Sequence[str] = ()) -> DataFrame:
    """Each step with the mean of its phase in the period."""
    x = positions(series, by).withColumn("phase", F.pmod("pos", F.lit(period)))
    means = x.groupBy(*by, "phase").agg(F.avg("value").alias("phase_mean"))
    return x.join(means, [*by, "phase"]).select(*by, "ts", "pos", "phase", "value", "phase_mean")


def seasonality_strength(series: DataFrame, period: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Variance of the seasonal part over the variance of the series, 0 when constant."""
    return _run(decompose(series, period, by=by), by, [
        F.coalesce(F.try_divide(F.var_samp("seasonal"), F.var_samp("value")), F.lit(0.0)).alias("strength")])


def _changes(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Steps with their position and the relative change to the step before."""
    def change(w) -> dict[str, Column]:
        before = F.lag("value").over(w)
        return {"change": F.try_divide(F.col("value") - before, before)}
    return framed(positions(series, by), by, 1, change)


def percent_change(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ts, value, change): relative change to the step before."""
    return _changes(series, by).select(*by, "ts", "value", "change")


def volatility(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _run(percent_change(series, by), by, [F.stddev_samp("change").alias("volatility")])


def _centred(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Steps numbered from 0, with the series' length, mean and the value less the mean."""
    x = numbered(series, by, "ts", {"v": (F.col("value"), None, "_total")}, n="n")
    return known_rows(x.withColumn("mean", F.col("_total") / F.col("n")).withColumn("e", F.col("value") - F.col("mean")).drop("_total"), x)


def _products(x: DataFrame, by: Sequence[str], lags: int) -> DataFrame:
    """(by, products): sums of e(t) e(t - j) for j = 0 .. lags. Pairs meet by (by, step), not by series."""
    later = x.select(*by, "pos", F.col("e").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("_lag"))
    later = later.select(*by, "_a", "_lag", (F.col("pos") - F.col("_lag")).alias("_pos"))
    earlier = x.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("pos").alias("_at"), F.col("e").alias("_b"))
    on = F.col("_pos") == F.col("_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    sums = later.join(earlier, on).groupBy(*by, "_lag").agg(F.sum(F.col("_a") * F.col("_b")).alias("_s"))
    return _run(sums, by, [F.transform(F.array_sort(F.collect_list(F.struct("_lag", "_s"))), lambda v: v["_s"]).alias("products")])


def _moments(x: DataFrame, by: Sequence[str], lags: int) -> DataFrame:
    """One row per series: n, mean, products, first and last values, last time stamp, range of the values."""
    edge = lags + 2
    def ordered(near: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("pos", "e")))), lambda v: v["e"])
    facts = _run(x, by, [
        F.first("n").alias("n"), F.first("mean").alias("mean"), (F.max("value") - F.min("value")).alias("spread"),
        ordered(F.col("pos") < edge).alias("head"), ordered(F.col("pos") >= F.col("n") - edge).alias("tail"),
        F.max("ts").alias("last")])
    sums = _products(x, by, lags)
    return _beside(facts, sums, by)


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two frames with one row per series, side by side."""
    if not by:
        return left.crossJoin(right)
    names = [f"_r{i}" for i in range(len(by))]
    other = right.select(*[F.col(c).alias(n) for c, n in zip(by, names)], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c, n in zip(by, names):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return left.join(other, on).drop(*names)


def _solve(moments: DataFrame, by: Sequence[str], run, fields: str) -> DataFrame:
    """`run(row) -> list of tuples` for the one row of each series."""
    types = {f.name: f.dataType.simpleString() for f in moments.schema}
    names = [f.split()[0] for f in fields.split(", ")]

    def apply(batches):
        for pdf in batches:
            rows = [(*(r[k] for k in by), *t) for r in pdf.to_dict("records") for t in run(r)]
            yield pd.DataFrame(rows, columns=[*by, *names])

    return moments.mapInPandas(apply, ", ".join([*(f"`{k}` {types[k]}" for k in by), fields]))


def _longest(series: DataFrame, by: Sequence[str]) -> int:
    """Steps of the longest series."""
    return (series.groupBy(*by).count() if by else series.agg(F.count(F.lit(1)).alias("count"))).agg(F.max("count")).first()[0] or 0


def unit_root_test(series: DataFrame, by: Sequence[str] = (), max_lag: int | None = None,
                   auto: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller test with constant; the lag is chosen by AIC unless fixed."""
    lags = max_lag if max_lag is not None else lagged.default_adf_lag(_longest(series, by))

    def run(r: dict) -> list[tuple]:
        if r["n"] < 10 or r["spread"] == 0:
            return [(r["n"], None, None, None, None)]
        t, used, rows = lagged.adf(lagged.Lagged(r["n"], r["products"], r["head"], r["tail"]), max_lag, auto)
        p = lagged.adf_p_value(t)
        return [(rows, t, used, p, p < 0.05)]
    return _solve(_moments(_centred(series, by), by, lags + 1), by, run,
                  "n bigint, statistic double, lags int, p_value double, is_stationary boolean")


def stationarity_test(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """KPSS test of level stationarity; p is kept inside [0.01, 0.10]."""
    x = _centred(series, by)
    running = numbered(x.drop("pos"), by, "ts", {"e": (F.col("e"), "_s", None)})
    squares = _run(running, by, [F.sum(F.col("_s") ** 2).alias("squares")])
    first = _moments(x, by, int(_longest(series, by) ** (2.0 / 9.0)))

    def lag(r: dict) -> list[tuple]:
        return [(None if r["n"] < 10 or r["spread"] == 0 else lagged.kpss_lag(r["n"], r["products"]), r["n"])]
    chosen = _solve(first, by, lag, "lags int, n bigint")
    most = chosen.agg(F.max("lags")).first()[0] or 0  # one number
    facts = _beside(_beside(chosen, squares, by), _products(x, by, most), by)

    def run(r: dict) -> list[tuple]:
        if pd.isna(r["lags"]):
            return [(r["n"], None, None, None, None)]
        stat = lagged.kpss(r["n"], r["products"], int(r["lags"]), r["squares"])
        p = lagged.kpss_p_value(stat)
        return [(r["n"], stat, int(r["lags"]), p, p > 0.05)]
    return _solve(facts, by, run, "n bigint, statistic double, lags int, p_value double, is_stationary boolean")


def _transformed(x: DataFrame, by: Sequence[str], forward: bool) -> DataFrame:
    """Four-step Fourier transform of every column pair: rows (by, n, length, idx, re, im, re2, im2), idx below the
    length, a power of two; missing idx count as zero. A task takes whole columns of the matrix, then whole rows."""
    keys = [*by, "n", "length"]
    fields = T.StructType([*(x.schema[k] for k in keys), *T._parse_datatype_string(
        "idx bigint, re double, im double, re2 double, im2 double").fields])
    own = [f.name for f in fields]
    many = 1 << 20  # values of a group

    def side(table: pa.Table, first: bool) -> pa.Table:
        length = table.column("length")[0].as_py()
        columns, rows = fourier.sides(length)
        idx = table.column("idx").to_numpy()
        # element j1 * rows + j2 lies in line j2 at j1; element k1 + columns * j2 in line k1 at j2
        line, at = (idx % rows, idx // rows) if first else (idx % columns, idx // columns)
        lines, which = np.unique(line, return_inverse=True)
        out = []
        for re, im in (("re", "im"), ("re2", "im2")):
            m = np.zeros((len(lines), columns if first else rows), complex)
            value = table.column(re).to_numpy() + 1j * table.column(im).to_numpy()
            m[which, at] = value if forward or not first else np.conj(value)
            m = fourier.first_side(m, lines, length) if first else np.fft.fft(m, axis=1)
            out += [m.real.ravel(), m.imag.ravel()]
        # first: k1 of line j2 goes to k1 + columns * j2; then k2 of line k1 to k1 + columns * k2
        step = np.arange(columns if first else rows)
        new = (step + columns * lines[:, None]) if first else (lines[:, None] + columns * step)
        size = new.size
        return pa.table([*(pa.repeat(table.column(k)[0], size) for k in keys), pa.array(new.ravel()),
                         *(pa.array(v) for v in out)], schema=to_arrow_schema(fields))

    def on_first(table: pa.Table) -> pa.Table:
        return side(table, True)

    def on_second(table: pa.Table) -> pa.Table:
        return side(table, False)

    for first in (True, False):
        bits = F.log2(F.col("length").cast("double")).cast("int")
        half = F.shiftright(bits, 1)
        columns, rows = F.pow(F.lit(2.0), half).cast("bigint"), F.pow(F.lit(2.0), bits - half).cast("bigint")
        lines, wide = (rows, columns) if first else (columns, rows)
        group = F.floor(F.pmod("idx", lines) / F.greatest(F.lit(1), F.floor(F.lit(many) / wide)))
        x = (x.select(*own).withColumn("_group", group).groupBy(*keys, "_group")
             .applyInArrow(on_first if first else on_second, fields))
    return x


def _powers(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, frequency, power) of centred series of any length, from (by, n, pos, e). The chirp turns the transform
    into a convolution of power-of-two length: two transforms, a product, one back; n log n work, four exchanges."""
    schema = T.StructType([*(x.schema[k] for k in by), *T._parse_datatype_string(
        "n bigint, length bigint, idx bigint, re double, im double, re2 double, im2 double").fields])
    names = [f.name for f in schema]

    def spread(batches):
        for batch in batches:
            n_of, pos, e = (batch.column(c).to_numpy() for c in ("n", "pos", "e"))
            for n in np.unique(n_of).tolist():
                at = np.flatnonzero(n_of == n)
                length, j = fourier.power_of_two(n), pos[at]
                w = fourier.chirp(j, n)
                a, b = e[at] * w, np.conj(w)
                rows = [(at, j, a, b)]
                back = at[j > 0]  # the chirp of negative places wraps around
                rows.append((back, length - pos[back], np.zeros(len(back)), np.conj(fourier.chirp(pos[back], n))))
                for where, idx, one, two in rows:
                    if len(where):
                        yield pa.RecordBatch.from_arrays(
                            [*(batch.column(k).take(pa.array(where)) for k in by), pa.array(np.full(len(where), n)),
                             pa.array(np.full(len(where), length)), pa.array(idx),
                             *(pa.array(np.ascontiguousarray(v, float)) for v in (np.real(one), np.imag(one), np.real(two), np.imag(two)))],
                            names=names)

    there = _transformed(x.select(*by, F.col("n").cast("bigint").alias("n"), "pos", "e").mapInArrow(spread, schema), by, True)
    product = there.select(*by, "n", "length", "idx", (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
                           (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"),
                           F.lit(0.0).alias("re2"), F.lit(0.0).alias("im2"))
    back = _transformed(product, by, False)
    # the chirp's factor has size one, and a transform back is divided by its length
    power = (F.col("re") ** 2 + F.col("im") ** 2) / F.col("length") ** 2
    return back.where("idx BETWEEN 1 AND n div 2").select(*by, "n", F.col("idx").alias("frequency"), power.alias("power"))


def periodogram(series: DataFrame, top: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, rank, frequency, period, power): the strongest positive frequencies of the mean-free series.

    Series that fit in one task are transformed there; others by a Fourier transform over all tasks.
    """
    fields = "frequency int, period double, power double"
    schema = T.StructType([*(series.schema[b] for b in by), *T._parse_datatype_string(f"rank int, {fields}").fields])
    if fits(series):
        def best(table: pa.Table) -> pa.Table:
            table = table.sort_by("ts")
            values = table.column("value").to_numpy()
            frequency, power = fourier.strongest(values, top) if len(values) > 1 else (np.zeros(0, int), np.zeros(0))
            return pa.table([*(pa.repeat(table.column(b)[0], len(power)) for b in by), pa.array(np.arange(1, len(power) + 1)),
                             pa.array(frequency), pa.array(len(values) / frequency), pa.array(power)],
                            names=[f.name for f in schema]).cast(to_arrow_schema(schema))
        grouped = series.groupBy(*by) if by else series.withColumn("_one", F.lit(0)).groupBy("_one")
        return grouped.applyInArrow(best, schema)
    power = _powers(_centred(series, by).where("n > 1"), by).select(
        *by, F.col("frequency").cast("int").alias("frequency"), (F.col("n") / F.col("frequency")).alias("period"), "power")
    order = [F.desc("power"), "frequency"]
    part = Window.partitionBy(*by, F.floor(F.col("frequency") / STRETCH))
    power = power.withColumn("_r", F.row_number().over(part.orderBy(*order))).where(F.col("_r") <= top).drop("_r")
    if not by:
        power = power.orderBy(*order).limit(top)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # `top` rows of each stretch
    return (power.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= top)
            .select(*by, "rank", "frequency", "period", "power"))


def _differenced(series: DataFrame, by: Sequence[str], d: int) -> DataFrame:
    for _ in range(d):
        moved = framed(positions(series, by), by, 1, lambda w: {"value": F.col("value") - F.lag("value").over(w)})
        series = known_rows(moved.where(F.col("value").isNotNull()).drop("pos"), series)
    return series


def _angles(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, angle, power): the frequencies that count for a likelihood, of series of any length."""
    power = _powers(_centred(series, by).where("n > 1"), by).where("frequency <= (n - 1) div 2")
    return power.select(*by, "n", (2 * F.pi() * F.col("frequency") / F.col("n")).alias("angle"),
                        (F.col("power") / F.col("n")).alias("power"))


def likelihood_fit(series: DataFrame, order: tuple[int, int, int] = (1, 0, 0), by: Sequence[str] = ()) -> DataFrame:
    """(by, n, ar, ma, variance, loglik): ARMA coefficients of the d-th difference that maximise Whittle's likelihood.

    Series that fit in one task are fitted there. Of longer ones the periodogram is made once; each scoring step is
    one job that adds up sums over its frequencies for all of them, and only coefficients and sums, one row for each
    such series, meet on the driver. Series with fewer than 3 * (p + q + 2) steps after differencing have no row.
    """
    p, d, q = order
    least = 3 * (p + q + 2)
    changed = _differenced(series, by, d)
    fields = "n bigint, ar array<double>, ma array<double>, variance double, loglik double"
    schema = T.StructType([*(series.schema[b] for b in by), *T._parse_datatype_string(fields).fields])
    names = [f.name for f in schema]
    if fits(series):
        def fitted(table: pa.Table) -> pa.Table:
            values = table.sort_by("ts").column("value").to_numpy()
            rows = []
            if len(values) >= least and np.ptp(values) > 0:
                ar, ma, variance, loglik = whittle.fit(values, p, q)
                rows = [[len(values)], [ar.tolist()], [ma.tolist()], [variance], [loglik]]
            own = [table.column(b).slice(0, bool(rows)) for b in by]
            return pa.table([*own, *(rows or [[]] * 5)], names=names).cast(to_arrow_schema(schema))
        grouped = changed.groupBy(*by) if by else changed.withColumn("_one", F.lit(0)).groupBy("_one")
        return grouped.applyInArrow(fitted, schema)
    return _fit_spread(changed, p, q, least, by, schema)


def _fit_spread(changed: DataFrame, p: int, q: int, least: int, by: Sequence[str], schema: T.StructType) -> DataFrame:
    spark = changed.sparkSession
    reach = lagged.long_order(_longest(changed, by), p, q) + max(p, q)
    found = [r for r in _moments(_centred(changed, by), by, reach + 1).collect() if r["n"] >= least and r["spread"] > 0]
    if not found:
        return spark.createDataFrame([], schema)
    runs = []
    for r in found:
        b = lagged.arma(lagged.Lagged(r["n"], r["products"], r["head"], r["tail"]), r["mean"], p, q)[0]
        runs.append(whittle.Climb(r["n"], b[1:1 + p], b[1 + p:]))
    table = spark.createDataFrame([(i, *(r[b] for b in by)) for i, r in enumerate(found)],
                                  T.StructType([T.StructField("_run", T.IntegerType()), *(changed.schema[b] for b in by)]))
    names = [f"_k{i}" for i in range(len(by))]
    keys = F.broadcast(table.select("_run", *[F.col(b).alias(k) for b, k in zip(by, names)]))  # one row for each series
    powers = _angles(changed, by)
    on = reduce(and_, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, names)], F.lit(True))
    powers = powers.join(keys, on).select("_run", "angle", "power").persist()
    try:
        while any(not c.done for c in runs):
            at = {i: c.parts() for i, c in enumerate(runs) if not c.done}

            def part(batches, at=at):
                total = {}
                for batch in batches:
                    run, angle, power = (c.to_numpy() for c in batch.columns)
                    for i in np.unique(run).tolist():
                        if i in at:
                            own = run == i
                            total[i] = total.get(i, 0) + whittle.sums(angle[own], power[own], *at[i])
                rows = [(i, j, float(v)) for i, s in total.items() for j, v in enumerate(s)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.float64()))],
                                                 names=["_run", "j", "v"])

            got = {}
            for r in powers.mapInArrow(part, "_run int, j int, v double").groupBy("_run", "j").agg(F.sum("v").alias("v")).collect():
                got.setdefault(r["_run"], {})[r["j"]] = r["v"]
            for i, s in got.items():
                runs[i].take(np.array([s[j] for j in range(len(s))]))
    finally:
        powers.unpersist()
    return spark.createDataFrame([(*(r[b] for b in by), r["n"], c.best[:p].tolist(), c.best[p:].tolist(), float(c.variance), float(c.value))
                                  for r, c in zip(found, runs)], schema)


def likelihood(series: DataFrame, ar: Sequence[float], ma: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, variance, loglik) of ARMA models with the coefficients given, by Whittle's likelihood."""
    ar, ma = (np.array(c, float) for c in (ar, ma))
    x = _angles(series, by) if not fits(series) else None
    schema = T.StructType([*(series.schema[b] for b in by), *T._parse_datatype_string("n bigint, variance double, loglik double").fields])
    if x is None:
        def valued(table: pa.Table) -> pa.Table:
            v = table.sort_by("ts").column("value").to_numpy()
            n, m = len(v), whittle.frequencies(len(v))
            rows = [[], [], []]
            if m > 0:
                power = np.abs(np.fft.rfft(v - v.mean())[1:m + 1]) ** 2 / n
                value, variance = whittle.log_likelihood(n, whittle.sums(2 * np.pi * np.arange(1, m + 1) / n, power, ar, ma))
                rows = [[n], [variance], [value]]
            return pa.table([*(table.column(b).slice(0, len(rows[0])) for b in by), *rows],
                            names=[f.name for f in schema]).cast(to_arrow_schema(schema))
        grouped = series.groupBy(*by) if by else series.withColumn("_one", F.lit(0)).groupBy("_one")
        return grouped.applyInArrow(valued, schema)
    # |1 + sum of c e^(-i k angle)|^2 as squares of its real and imaginary parts
    def size(sign: int, c: np.ndarray) -> Column:
        real = sum((F.lit(sign * float(v)) * F.cos((k + 1) * F.col("angle")) for k, v in enumerate(c)), F.lit(1.0))
        imaginary = sum((F.lit(sign * float(v)) * F.sin((k + 1) * F.col("angle")) for k, v in enumerate(c)), F.lit(0.0))
        return real * real + imaginary * imaginary
    x = x.withColumn("g", size(1, ma) / size(-1, ar))
    got = x.groupBy(*by, "n").agg(F.avg(F.col("power") / F.col("g")).alias("variance"), F.sum(F.log("g")).alias("_g"))
    value = -0.5 * F.col("n") * (F.log(2 * F.pi() * F.col("variance")) + 1) - F.col("_g")
    return got.select(*by, "n", "variance", value.alias("loglik"))


def forecast(series: DataFrame, order: tuple[int, int, int] = (1, 1, 1), steps: int = 30,
             by: Sequence[str] = (), step: str = "1 day", method: str = "likelihood") -> DataFrame:
    """(by, step, ts, forecast, low, high, aic, bic) for each series.

    Coefficients maximise Whittle's likelihood (likelihood_fit), or come from conditional least squares
    (Hannan-Rissanen) on sums of lagged products with method="least_squares". Series with fewer than
    d + 3 * (p + q + 2) steps, and constant ones under the likelihood, have no rows.
    """
    p, d, q = order
    if method not in ("likelihood", "least_squares"):
        raise ValueError("method is 'likelihood' or 'least_squares'")
    ends = _run(numbered(series, by, "ts", n="_n").where(F.col("pos") >= F.col("_n") - max(d, 1)),
                by, [F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"]).alias("ends"),
                     F.first("_n").alias("steps")])
    changed = _differenced(series, by, d)
    reach = lagged.long_order(_longest(series, by), p, q) + max(p, q)
    moments = _beside(_moments(_centred(changed, by), by, reach + 1), ends, by)
    likely = method == "likelihood"
    if likely:
        moments = _beside(moments, likelihood_fit(series, order, by).select(*by, "ar", "ma", "variance", "loglik"), by)

    def run(r: dict) -> list[tuple]:
        if r["steps"] < d + 3 * (p + q + 2):
            return []
        fitted = tuple(np.array(r[c], float) for c in ("ar", "ma")) + (r["variance"], r["loglik"]) if likely else None
        got = lagged.forecast(lagged.Lagged(r["n"], r["products"], r["head"], r["tail"]), r["mean"], r["ends"], p, d, q, steps, fitted)
        return [(i + 1, r["last"], f, f - 1.959963984540054 * s, f + 1.959963984540054 * s, got["aic"], got["bic"])
                for i, (f, s) in enumerate(zip(got["forecast"].tolist(), got["se"].tolist()))]

    kind = series.schema["ts"].dataType.simpleString()
    out = _solve(moments, by, run, f"step int, last {kind}, forecast double, low double, high double, aic double, bic double")
    return out.withColumn("ts", F.col("last") + F.col("step") * F.expr(f"INTERVAL {step}")).select(
        *by, "step", "ts", "forecast", "low", "high", "aic", "bic")


def trend(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slope, fit, direction, strength and volatility of each series with at least ten steps;
    with 24 or more also unit root test and seasonal strength at period 12."""
    x = _changes(series, by)
    s = pair_sums(F.col("pos").cast("double"), F.col("value"))
    g = _run(x, by, [*[e.alias(k) for k, e in s.items()], F.stddev_samp("change").alias("volatility")])
    g = g.where(F.col("n") >= MIN_TREND).withColumn("r", pearson(F.col("sxy"), F.col("sxx"), F.col("syy")))
    g = g.withColumn("p_value", r_p_value(F.col("r"), F.col("n")))
    real = F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    slope = F.try_divide("sxy", "sxx")
    direction = F.when(real & (slope > 0), "upward").when(real, "downward").otherwise("none")
    strength = F.when(~real, "weak").when(F.abs("r") > 0.7, "strong").otherwise("moderate")
    out = g.select(*by, "n", slope.alias("slope"), (F.col("r") ** 2).alias("r_squared"), "p_value",
                   direction.alias("direction"), strength.alias("strength"), "volatility")
    parts = _run(decompose(series, TREND_PERIOD, by=by), by, [
        F.try_divide(F.stddev_samp("seasonal"), F.stddev_samp("value")).alias("_seasonal")])
    root = unit_root_test(series, by).select(*by, F.col("is_stationary").alias("_stationary"))
    out = (out.join(parts, list(by), "left").join(root, list(by), "left") if by
           else out.crossJoin(parts).crossJoin(root))  # one row each
    enough = F.col("n") >= MIN_SEASONAL
    return (out.withColumn("is_stationary", F.when(enough, F.col("_stationary")))
            .withColumn("seasonal_strength", F.when(enough, F.col("_seasonal")))
            .withColumn("has_seasonality", F.when(enough, F.col("_seasonal") > 0.1)).drop("_stationary", "_seasonal"))
