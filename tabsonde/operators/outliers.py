"""Outlier flags and their treatment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.plans.quantiles import column_quantiles
from tabsonde.schema import as_double, missing, numeric_columns, require_numeric

MIN_VALUES = 10


def outlier_bounds(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                   k: float | None = None) -> dict[str, tuple[float, float]]:
    """Normal range per column: quartiles -/+ k IQR (k 1.5) or mean -/+ k std (k 3).

    Columns with fewer than ten values or no spread have no range.
    """
    cols = list(cols or numeric_columns(df))
    require_numeric(df, cols)
    facts = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(as_double(c)).alias(f"n{i}"), F.avg(as_double(c)).alias(f"m{i}"),
        F.stddev_samp(as_double(c)).alias(f"s{i}"))]).first()
    usable = [c for i, c in enumerate(cols) if facts[f"n{i}"] >= MIN_VALUES]
    out: dict[str, tuple[float, float]] = {}
    if method == "iqr":
        k = 1.5 if k is None else k
        q = column_quantiles(df, usable, [0.25, 0.75]) if usable else {}
        for c in usable:
            lo, hi = q[c, 0.25], q[c, 0.75]
            if hi != lo:
                out[c] = (lo - k * (hi - lo), hi + k * (hi - lo))
    elif method == "zscore":
        k = 3.0 if k is None else k
        for i, c in enumerate(cols):
            if c in usable and facts[f"s{i}"]:
                out[c] = (facts[f"m{i}"] - k * facts[f"s{i}"], facts[f"m{i}"] + k * facts[f"s{i}"])
    else:
        raise ValueError(f"unknown method: {method}")
    return out


def is_outlier(c: str, bounds: dict[str, tuple[float, float]]) -> Column:
    if c not in bounds:
        return F.lit(False)
    lo, hi = bounds[c]
    return F.coalesce((as_double(c) < lo) | (as_double(c) > hi), F.lit(False))


def flag_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                  k: float | None = None) -> DataFrame:
    """Add one boolean `<column>_outlier` per column."""
    cols = list(cols or numeric_columns(df))
    bounds = outlier_bounds(df, cols, method, k)
    return df.select("*", *[is_outlier(c, bounds).alias(f"{c}_outlier") for c in cols])


def outlier_rows(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None,
                 method: str = "iqr", k: float | None = None) -> DataFrame:
    """(keys, column_name, value, lower, upper): one row per outlying cell."""
    cols = list(cols or numeric_columns(df))
    bounds = outlier_bounds(df, cols, method, k)
    cells = [F.when(is_outlier(c, bounds), F.struct(
        F.lit(c).alias("column_name"), as_double(c).alias("value"),
        F.lit(float(bounds[c][0])).alias("lower"), F.lit(float(bounds[c][1])).alias("upper")))
        for c in cols if c in bounds]
    if not cells:
        return df.select(*keys, F.lit("").alias("column_name"), *[
            F.lit(0.0).alias(x) for x in ("value", "lower", "upper")]).where(F.lit(False))
    return (df.select(*keys, F.explode_outer(F.array(*cells)).alias("c")).where("c IS NOT NULL")
            .select(*keys, "c.*"))


def remove_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                    k: float | None = None) -> DataFrame:
    """Drop rows that are outlying in any of the columns."""
    cols = list(cols or numeric_columns(df))
    bounds = outlier_bounds(df, cols, method, k)
    for c in bounds:
        df = df.where(~is_outlier(c, bounds))
    return df


def cap_outliers(df: DataFrame, cols: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clip columns to their own quantiles; null stays null."""
    require_numeric(df, cols)
    q = column_quantiles(df, cols, [low, high])

    def clipped(c: str) -> Column:
        if q[c, low] is None:
            return as_double(c)
        return F.when(~missing(df, c), F.greatest(F.least(as_double(c), F.lit(q[c, high])), F.lit(q[c, low])))

    return df.select(*[clipped(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def replace_outliers(df: DataFrame, cols: Sequence[str], statistic: str = "mean", method: str = "iqr",
                     k: float | None = None) -> DataFrame:
    """Replace outlying values by the mean or median of the whole column."""
    bounds = outlier_bounds(df, cols, method, k)
    if statistic == "mean":
        row = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        stat = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    elif statistic == "median":
        q = column_quantiles(df, cols, [0.5])
        stat = {c: q[c, 0.5] for c in cols}
    else:
        raise ValueError("statistic is 'mean' or 'median'")
    return df.select(*[F.when(is_outlier(c, bounds), F.lit(stat[c])).otherwise(as_double(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def preprocessing_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row comparing shape and missing cells of two states of a table."""
    def facts(df: DataFrame, tag: str) -> DataFrame:
        cells = sum((missing(df, c).cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
        return df.agg(F.count(F.lit(1)).alias(f"rows_{tag}"),
                      F.coalesce(F.sum(cells), F.lit(0)).alias(f"missing_{tag}")) \
            .withColumn(f"columns_{tag}", F.lit(len(df.columns)).cast("bigint"))
    # Both sides are one row.
    return (facts(before, "before").crossJoin(facts(after, "after"))
            .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after")))
