"""Linear regression from sums of squares and products, one scan whatever the row count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.functions.special import t_two_sided
from tabsonde.operators.correlation import r_p_value
from tabsonde.plans.aggregates import pair_sums
from tabsonde.schema import as_double, require_columns, require_numeric


def complete_rows(df: DataFrame, predictors: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows where target and predictors are present, as doubles, next to the kept columns."""
    names = [*predictors, target]
    require_numeric(df, names)
    out = df.select(*keep, *[as_double(c).alias(c) for c in names if c not in keep])
    return out.na.drop(subset=names)


def gram(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, means, cov): covariances of all pairs, upper triangle row by row."""
    pairs = list(combinations_with_replacement(names, 2))
    aggs = [F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"),
            F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _solve(n: int, means: np.ndarray, cov: np.ndarray, predictors: list[str]) -> list[tuple]:
    p = len(predictors)
    full = np.zeros((p + 1, p + 1))
    full[np.triu_indices(p + 1)] = cov
    full = full + np.triu(full, 1).T
    sxx, sxy, syy = full[:p, :p] * n, full[:p, p] * n, full[p, p] * n
    scale = np.sqrt(np.diag(sxx))
    singular = n <= p or not np.all(scale > 0)
    if not singular:
        corr = sxx / np.outer(scale, scale)
        singular = np.linalg.matrix_rank(corr, tol=1e-10) < p
    if singular:
        return [(t, None, None, None, None, int(n), None, None) for t in ["intercept", *predictors]]
    inv = np.linalg.inv(corr) / np.outer(scale, scale)
    beta = inv @ sxy
    rss = max(float(syy - beta @ sxy), 0.0)
    intercept = means[p] - beta @ means[:p]
    r2 = 1.0 - rss / syy if syy > 0 else None
    dof = n - p - 1
    if dof <= 0:
        return [(t, float(c), None, None, None, int(n), r2, None)
                for t, c in zip(["intercept", *predictors], [intercept, *beta])]
    mse = rss / dof
    se = np.sqrt(mse * np.r_[1.0 / n + means[:p] @ inv @ means[:p], np.diag(inv)])
    out = []
    for term, c, s in zip(["intercept", *predictors], [intercept, *beta], se):
        t = float(c / s) if s > 0 else None
        out.append((term, float(c), float(s), t, t_two_sided(t, dof) if t is not None else None, int(n), r2, mse))
    return out


def linear_regression(df: DataFrame, predictors: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, term, coefficient, std_error, t, p_value, n, r_squared, mse) by least squares.

    Collinear predictors give null coefficients.
    """
    predictors, by = list(predictors), list(by)
    require_columns(df, by)
    sums = gram(complete_rows(df, predictors, target, by), [*predictors, target], by).where(F.col("n") > 0)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    fields = "term string, coefficient double, std_error double, t double, p_value double, n bigint, r_squared double, mse double"
    names = [f.split()[0] for f in fields.split(", ")]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # one row per group, p * p numbers each
            rows = []
            for r in pdf.to_dict("records"):
                got = _solve(r["n"], np.array(r["means"], float), np.array(r["cov"], float), predictors)
                rows += [tuple(r[k] for k in by) + g for g in got]
            yield pd.DataFrame(rows, columns=[*by, *names])

    return sums.mapInPandas(solve, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), fields]))


def coefficients(df: DataFrame, predictors: Sequence[str], target: str) -> dict[str, float | None]:
    """{term: coefficient} of the whole table (predictors + 1 numbers)."""
    return {r["term"]: r["coefficient"] for r in linear_regression(df, predictors, target).collect()}


def fitted(coef: dict[str, float | None]) -> Column:
    """The fitted value as a column of the predictors."""
    if any(v is None for v in coef.values()):
        return F.lit(None).cast("double")
    out = F.lit(coef["intercept"])
    for term, c in coef.items():
        if term != "intercept":
            out = out + F.lit(c) * F.col(term)
    return out


def predictions(df: DataFrame, predictors: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, target, fitted, residual) for every complete row."""
    rows = complete_rows(df, predictors, target, keep)
    coef = coefficients(df, predictors, target)
    return (rows.withColumn("fitted", fitted(coef)).withColumn("residual", F.col(target) - F.col("fitted"))
            .select(*keep, F.col(target).alias("actual"), "fitted", "residual"))


def simple_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, slope, intercept, r, r_squared, std_error, p_value) of y on x over complete pairs."""
    require_numeric(df, [x, y])
    s = [e.alias(k) for k, e in pair_sums(as_double(x), as_double(y)).items()]
    g = df.groupBy(*by).agg(*s) if by else df.agg(*s)
    slope = F.try_divide("sxy", "sxx")
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    rest = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    return (g.withColumn("slope", slope).withColumn("intercept", F.col("mean_y") - slope * F.col("mean_x"))
            .withColumn("r", r).withColumn("r_squared", F.col("r") ** 2)
            .withColumn("std_error", F.sqrt(F.try_divide(F.try_divide(rest, F.col("n") - 2), F.col("sxx"))))
            .withColumn("p_value", r_p_value(F.col("r"), F.col("n")))
            .select(*by, "n", "slope", "intercept", "r", "r_squared", "std_error", "p_value"))


def split_bucket(key: Sequence[str], seed: int = 42, buckets: int = 10) -> Column:
    """A number 0 .. buckets - 1 fixed by the row's key, for splits that do not depend on
    partitioning or re-evaluation: the first 32 bits of the MD5 of the key's values and the seed."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets)).cast("int")


def predictive_analysis(df: DataFrame, predictors: Sequence[str], target: str, key: Sequence[str]) -> DataFrame:
    """Fit on a hash split of 80 %, score the rest: r2, rmse and terms by absolute coefficient."""
    rows = complete_rows(df.withColumn("_split", split_bucket(key)), predictors, target, ["_split"])
    train, test = rows.where("_split < 8"), rows.where("_split >= 8")
    coef = coefficients(train, predictors, target)
    scored = test.select(F.col(target).alias("y"), fitted(coef).alias("f"))
    score = scored.agg(F.sum((F.col("y") - F.col("f")) ** 2).alias("rss"), (F.var_pop("y") * F.count("y")).alias("tss"),
                       F.count("y").alias("n_test"))
    terms = [F.struct(F.lit(p).alias("feature"), F.lit(coef[p]).cast("double").alias("coefficient"),
                      F.abs(F.lit(coef[p]).cast("double")).alias("importance")) for p in predictors]
    ranked = F.reverse(F.array_sort(F.transform(F.array(*terms), lambda s: F.struct(
        s["importance"], s["feature"], s["coefficient"]))))
    out = score.select((1 - F.try_divide("rss", "tss")).alias("r2"), F.sqrt(F.try_divide("rss", "n_test")).alias("rmse"),
                       "n_test", F.posexplode(ranked).alias("i", "s"))
    return out.select((F.col("i") + 1).alias("rank"), F.col("s.feature").alias("feature"),
                      F.col("s.coefficient").alias("coefficient"), F.col("s.importance").alias("importance"),
                      "r2", "rmse", "n_test")
