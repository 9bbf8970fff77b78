"""Hypothesis tests. `by` runs one test per group of rows in the same job.

Tests reduce the table to moments or counts with grouped aggregates; p-values are computed
on the result rows only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsonde.functions.normal import norm_cdf, norm_log_cdf, norm_ppf
from tabsonde.functions.special import (chi2_upper_col, f_upper_col, kolmogorov_upper_col,
                                        normal_upper_col, t_two_sided_col)
from tabsonde.plans.ordering import attach, ranked_frequency
from tabsonde.plans.quantiles import few_groups, grouped_quantiles
from tabsonde.schema import as_double, require_columns, require_numeric

SHAPIRO_LIMIT = 5000
# Anderson-Darling critical points for a normal with estimated parameters.
ANDERSON_LEVELS = {"15%": 0.576, "10%": 0.656, "5%": 0.787, "2.5%": 0.918, "1%": 1.092}


def _agg(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _match(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two results that have one row per `by` key."""
    return a.join(b, list(by)) if by else a.crossJoin(b)


def _values(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """Group columns and the value `_v`, rows with any of them missing left out."""
    out = df.select(*cols, as_double(value).alias("_v")).where(F.col("_v").isNotNull())
    for c in cols:
        out = out.where(F.col(c).isNotNull())
    return out


def group_moments(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, group, n, mean, std) of the present values."""
    require_columns(df, [group, *by])
    require_numeric(df, [value])
    return (_values(df, [*by, group], value).groupBy(*by, group)
            .agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std")))


def _anova(values: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """(by, n, k, f) from the spread inside the groups and over all rows."""
    groups = values.groupBy(*by, group).agg(F.count("_v").alias("n"), F.var_pop("_v").alias("v"))
    inside = _agg(groups, by, [F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw")])
    overall = _agg(values, by, [F.count("_v").alias("n"), (F.count("_v") * F.var_pop("_v")).alias("sst")])
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("sst") - F.col("ssw"), df1), F.try_divide(F.col("ssw"), df2))
    return _match(inside, overall, by).select(*by, "n", "k", df1.alias("df_between"), df2.alias("df_within"),
                                              F.when(F.col("k") >= 2, f).alias("f"))


def anova(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance; under two groups the statistic is null."""
    require_numeric(df, [value])
    out = _anova(_values(df, [*by, group], value), group, by)
    return out.withColumn("p_value", f_upper_col(F.col("f"), F.col("df_between"), F.col("df_within")))


def _deviations(values: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """Absolute distance of every value from its group's median, as `_v`."""
    keys = [*by, group]
    medians = grouped_quantiles(values, keys, ["_v"], {"_median": 0.5}).drop("column_name")
    if few_groups(values, keys) is not None:
        joined = values.join(F.broadcast(medians), keys)
    else:
        joined = attach(values, medians, keys, values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    return (joined
            .select(*keys, F.abs(F.col("_v") - F.col("_median")).alias("_v")))


def levene(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Equality of variances, centred on the group medians."""
    require_numeric(df, [value])
    values = _values(df, [*by, group], value)
    out = _anova(_deviations(values, group, by), group, by)
    return out.withColumnRenamed("f", "w").withColumn(
        "p_value", f_upper_col(F.col("w"), F.col("df_between"), F.col("df_within")))


def two_groups(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per `by` key with the moments of the smallest and largest group value.

    `n_groups` tells whether there are exactly two.
    """
    g = group_moments(df, group, value, by)
    facts = F.struct(F.col(group).alias("g"), "n", "mean", "std")
    two = _agg(g, by, [F.count(F.lit(1)).alias("n_groups"), F.min_by(facts, group).alias("a"),
                       F.max_by(facts, group).alias("b")])
    out = [F.col(f"{s}.{f}").alias(name) for s, i in (("a", 1), ("b", 2))
           for f, name in (("g", f"group_{i}"), ("n", f"n_{i}"), ("mean", f"mean_{i}"), ("std", f"std_{i}"))]
    return two.select(*by, "n_groups", *out)


def effect_size() -> Column:
    """Cohen's d of group 1 minus group 2 over the root mean of both variances."""
    pooled = F.sqrt((F.col("std_1") ** 2 + F.col("std_2") ** 2) / 2)
    return F.try_divide(F.col("mean_1") - F.col("mean_2"), pooled)


def pooled_t() -> tuple[Column, Column]:
    n1, n2 = F.col("n_1"), F.col("n_2")
    dof = (n1 + n2 - 2).cast("double")
    var = F.try_divide((n1 - 1) * F.col("std_1") ** 2 + (n2 - 1) * F.col("std_2") ** 2, dof)
    return F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(var * (1 / n1 + 1 / n2))), dof


def welch_t() -> tuple[Column, Column]:
    a, b = F.col("std_1") ** 2 / F.col("n_1"), F.col("std_2") ** 2 / F.col("n_2")
    dof = F.try_divide((a + b) ** 2, F.try_divide(a * a, F.col("n_1") - 1) + F.try_divide(b * b, F.col("n_2") - 1))
    return F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(a + b)), dof


def t_test(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Independent t-test of two groups in sorted order.

    Levene p over 0.05 selects the pooled test, otherwise Welch's. Keys without exactly two
    groups keep their row with null statistics.
    """
    two = two_groups(df, group, value, by)
    lev = levene(df, group, value, by).select(*by, F.col("w").alias("levene_w"), F.col("p_value").alias("levene_p"))
    valid = F.col("n_groups") == 2
    (tp, dp), (tw, dw) = pooled_t(), welch_t()
    pooled = F.col("levene_p") > 0.05
    out = (_match(two, lev, by)
           .withColumn("equal_var", F.when(valid, F.coalesce(pooled, F.lit(False))))
           .withColumn("statistic", F.when(valid, F.when(F.col("equal_var"), tp).otherwise(tw)))
           .withColumn("dof", F.when(valid, F.when(F.col("equal_var"), dp).otherwise(dw)))
           .withColumn("effect_size", F.when(valid, effect_size())))
    return out.withColumn("p_value", t_two_sided_col(F.col("statistic"), F.col("dof")))


def paired_t_test(df: DataFrame, group: str, value: str, pair_key: Sequence[str],
                  by: Sequence[str] = ()) -> DataFrame:
    """Paired t-test: values of the two groups are matched by `pair_key`, one per side.

    Both groups must be equally large and every key present in both; otherwise the row has
    null statistics. `n_pairs` is the number of matched keys.
    """
    require_numeric(df, [value])
    values = _values(df, [*by, *pair_key, group], value)
    ends = _agg(values, by, [F.min(group).alias("group_1"), F.max(group).alias("group_2"),
                             F.count_if(F.lit(True)).alias("n_rows")])
    sides = _agg(values.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n")), by,
                 [F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("n_small"), F.max("n").alias("n_large")])
    per_key = values.groupBy(*by, *pair_key).agg(
        F.min_by("_v", group).alias("x"), F.max_by("_v", group).alias("y"), F.count(F.lit(1)).alias("c"))
    d = (F.col("x") - F.col("y")).alias("d")
    diff = per_key.where(F.col("c") == 2).select(*by, d)
    stats = _agg(diff, by, [F.count("d").alias("n_pairs"), F.avg("d").alias("mean_difference"),
                            F.stddev_samp("d").alias("std_difference")])
    valid = ((F.col("n_groups") == 2) & (F.col("n_small") == F.col("n_large"))
             & (F.col("n_pairs") == F.col("n_small")))
    t = F.try_divide(F.col("mean_difference") * F.sqrt("n_pairs"), F.col("std_difference"))
    return (_match(_match(ends.drop("n_rows"), sides, by), stats, by)
            .withColumn("statistic", F.when(valid, t)).withColumn("dof", F.when(valid, F.col("n_pairs") - 1))
            .withColumn("p_value", t_two_sided_col(F.col("statistic"), F.col("dof")))
            .drop("n_small", "n_large"))


def chi_square(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Independence of two columns: chi2, dof, Cramer's V; Yates' correction at one dof.

    Empty cells add nothing to sum(O^2 / E) - n, so only combinations that occur are counted
    and no grid is built. In a 2 x 2 table |O - E| is the same in all cells.
    """
    require_columns(df, [a, b, *by])
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy(*by, a).agg(F.sum("o").alias("r"))
    cb = cells.groupBy(*by, b).agg(F.sum("o").alias("c"))
    inv = lambda g, v, k: _agg(g, by, [F.sum(1 / F.col(v)).alias(f"inv_{v}"), F.count(F.lit(1)).alias(k)])
    total = _agg(cells, by, [F.sum("o").alias("n")])
    # A value with very many partners is a hot key of this join.
    grid = attach(cells, ra, [*by, a], cells.groupBy(*by, a).agg(F.count(F.lit(1)).alias("n")))
    grid = attach(grid, cb, [*by, b], cells.groupBy(*by, b).agg(F.count(F.lit(1)).alias("n")))
    grid = grid.join(total, list(by)) if by else grid.crossJoin(F.broadcast(total))
    e = F.col("r") * F.col("c") / F.col("n")
    sums = _agg(grid, by, [F.sum(F.col("o") * F.col("o") / e).alias("s"), F.max(F.abs(F.col("o") - e)).alias("d"),
                           F.max("n").alias("n")])
    out = _match(_match(sums, inv(ra, "r", "k_a"), by), inv(cb, "c", "k_b"), by)
    dof = (F.col("k_a") - 1) * (F.col("k_b") - 1)
    yates = (F.col("d") - F.least(F.lit(0.5), F.col("d"))) ** 2 * F.col("n") * F.col("inv_r") * F.col("inv_c")
    chi2 = F.when(dof == 0, 0.0).when(dof == 1, yates).otherwise(F.greatest(F.col("s") - F.col("n"), F.lit(0.0)))
    small = F.least("k_a", "k_b") - 1
    return (out.withColumn("chi2", chi2).withColumn("dof", dof)
            .withColumn("cramers_v", F.sqrt(F.try_divide("chi2", F.col("n") * small)))
            .withColumn("p_value", F.when(F.col("dof") > 0, chi2_upper_col(F.col("chi2"), F.col("dof"))).otherwise(1.0))
            .select(*by, "n", "chi2", "dof", "cramers_v", "p_value"))


def normality_jarque_bera(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = as_double(value)
    out = _agg(df, by, [F.count(v).alias("n"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k")])
    stat = F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    return out.select(*by, "n", stat.alias("statistic"), F.exp(-stat / 2).alias("p_value"))


def _standardised(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Distinct values with count n, running count upto, group size m and z-score."""
    values = df.select(*by, as_double(value).alias("_v")).where(F.col("_v").isNotNull())
    stats = _agg(values, by, [F.count("_v").alias("m"), F.avg("_v").alias("mu"), F.stddev_samp("_v").alias("sd")])
    ranked = ranked_frequency(values, "_v", by)
    if by:
        joined = attach(ranked, stats, by, stats.select(*by, F.col("m").alias("n")))
    else:
        joined = ranked.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn("z", F.try_divide(F.col("_v") - F.col("mu"), F.col("sd")))


def normality_ks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov distance to a normal with the sample mean and std."""
    z = _standardised(df, value, by).withColumn("c", norm_cdf(F.col("z")))
    d = F.greatest(F.col("upto") / F.col("m") - F.col("c"), F.col("c") - (F.col("upto") - F.col("n")) / F.col("m"))
    out = _agg(z, by, [F.max("m").alias("n"), F.max(d).alias("statistic")])
    return out.withColumn("p_value", kolmogorov_upper_col(F.col("statistic"), F.col("n")))


def normality_anderson(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Anderson-Darling statistic with five critical values; `rejected_at` is the strictest
    level whose critical value it exceeds.

    Ties share the sum over their ranks, so distinct values with counts are enough.
    """
    z = (_standardised(df, value, by).withColumn("lo", norm_log_cdf(F.col("z")))
         .withColumn("hi", norm_log_cdf(-F.col("z"))))
    i = F.col("upto") - (F.col("n") - 1) / 2
    term = F.col("n") * ((2 * i - 1) * F.col("lo") + (2 * (F.col("m") - i) + 1) * F.col("hi"))
    out = _agg(z, by, [F.max("m").alias("n"), F.sum(term).alias("t")])
    n = F.col("n")
    out = out.withColumn("statistic", -n - F.col("t") / n)
    scale = 1 + 4 / n - 25 / (n * n)
    names = [f"critical_{k[:-1].replace('.', '_')}" for k in ANDERSON_LEVELS]
    for name, c in zip(names, ANDERSON_LEVELS.values()):
        out = out.withColumn(name, F.round(F.lit(c) / scale, 3))
    level = F.lit(None).cast("string")
    for name, k in zip(names, ANDERSON_LEVELS):
        level = F.when(F.col("statistic") > F.col(name), F.lit(k)).otherwise(level)
    return out.select(*by, "n", "statistic", *names, level.alias("rejected_at"))


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normality_shapiro(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk (Royston 1995) for groups of 3 to 5,000 values.

    Larger groups get no statistic, as the test is defined only up to that size, and the reason says
    so; the limit also bounds the rows that are ranked in one task.
    """
    require_numeric(df, [value])
    values = df.select(*by, as_double(value).alias("_v")).where(F.col("_v").isNotNull())
    size = _agg(values, by, [F.count("_v").alias("m"), F.avg("_v").alias("mu"), F.var_pop("_v").alias("var")])
    fit = size.where(F.col("m").between(3, SHAPIRO_LIMIT) & (F.col("var") > 0))
    if by:
        # Groups of at most 5,000 rows. Bigger ones go before the join: those with a thousandth of all
        # rows or more, at most a thousand, by a broadcast of their keys.
        total = size.agg(F.sum("m").alias("t")).scalar()
        big = F.broadcast(size.where((F.col("m") > SHAPIRO_LIMIT) & (F.col("m") * 1000 > total)).select(*by))
        rows = values.join(big, list(by), "left_anti").join(fit, list(by))
        w = Window.partitionBy(*by).orderBy("_v")
    else:
        rows = values.crossJoin(F.broadcast(fit))
        w = Window.partitionBy(F.lit(0)).orderBy("_v")
    m = F.col("m")
    ranked = rows.withColumn("i", F.row_number().over(w)).withColumn("q", norm_ppf((F.col("i") - 0.375) / (m + 0.25)))
    # Polynomial coefficients of Royston's approximation.
    ss = ranked.groupBy(*by, "m", "mu", "var").agg(
        F.sum(F.col("q") ** 2).alias("ssq"), F.max("q").alias("q1"),
        F.max(F.when(F.col("i") == m - 1, F.col("q"))).alias("q2"), F.sum(F.col("q") * F.col("_v")).alias("qx"),
        F.min("_v").alias("x_1"), F.max("_v").alias("x_n"),
        F.max(F.when(F.col("i") == 2, F.col("_v"))).alias("x_2"),
        F.max(F.when(F.col("i") == m - 1, F.col("_v"))).alias("x_m"))
    u = 1 / F.sqrt(m)
    root = F.sqrt("ssq")
    an = _poly([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u) + F.col("q1") / root
    an1 = _poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) + F.col("q2") / root
    two = m > 5
    phi = F.when(two, (F.col("ssq") - 2 * F.col("q1") ** 2 - 2 * F.col("q2") ** 2)
                 / (1 - 2 * F.col("an") ** 2 - 2 * F.col("an1") ** 2)) \
        .otherwise((F.col("ssq") - 2 * F.col("q1") ** 2) / (1 - 2 * F.col("an") ** 2))
    ss = ss.withColumn("an", an).withColumn("an1", an1).withColumn("phi", phi)
    ends = F.col("an") * (F.col("x_n") - F.col("x_1"))
    inner_all = F.col("qx") - F.col("q1") * (F.col("x_n") - F.col("x_1"))
    big = ends + F.when(two, F.col("an1") * (F.col("x_m") - F.col("x_2"))
                        + (inner_all - F.col("q2") * (F.col("x_m") - F.col("x_2"))) / F.sqrt("phi")) \
        .otherwise(F.when(m > 3, inner_all / F.sqrt(F.when(m > 3, F.col("phi")).otherwise(1.0))).otherwise(0.0))
    three = F.lit(math.sqrt(0.5)) * (F.col("x_n") - F.col("x_1"))
    numerator = F.when(m == 3, three).otherwise(big)
    wstat = F.least(numerator ** 2 / (m * F.col("var")), F.lit(1.0))
    out = ss.select(*by, m.alias("n"), wstat.alias("statistic"))
    n, wv = F.col("n"), F.col("statistic")
    ln = F.log(n)
    small_mu = _poly([-0.0006714, 0.0250540, -0.39978, 0.5440], n)
    small_sd = F.exp(_poly([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    gamma = 0.459 * n - 2.273
    y = F.log(F.greatest(1 - wv, F.lit(1e-300)))
    z = F.when(n <= 11, (-F.log(F.greatest(gamma - y, F.lit(1e-300))) - small_mu) / small_sd).otherwise(
        (y - _poly([0.0038915, -0.083751, -0.31082, -1.5861], ln))
        / F.exp(_poly([0.0030302, -0.082676, -0.4803], ln)))
    p3 = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt(wv)) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    done = out.withColumn("p_value", F.when(n == 3, p3).otherwise(normal_upper_col(z)))
    reason = (F.when(F.col("n") < 3, "fewer than 3 values").when(F.col("n") > SHAPIRO_LIMIT, "more than 5,000 values")
              .when(F.col("statistic").isNull(), "constant"))
    return size.select(*by, m.alias("n")).join(done, [*by, "n"], "left").withColumn("reason", reason)


def normality_tests(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, test, n, statistic, p_value): all four normality tests in one table."""
    parts = [(name, fn(df, value, by)) for name, fn in (
        ("shapiro_wilk", normality_shapiro), ("kolmogorov_smirnov", normality_ks),
        ("anderson_darling", normality_anderson), ("jarque_bera", normality_jarque_bera))]
    out = None
    for name, f in parts:
        if "p_value" not in f.columns:
            f = f.withColumn("p_value", F.lit(None).cast("double"))
        f = f.select(*by, F.lit(name).alias("test"), "n", "statistic", "p_value")
        out = f if out is None else out.unionByName(f)
    return out
