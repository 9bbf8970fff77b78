"""Grouped aggregates, shares and contingency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.plans.ordering import attach
from tabsonde.schema import as_double, require_columns

AGGREGATES = {
    "count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct, "median": F.median, "skew": F.skewness,
    "product": F.product, "size": lambda c: F.count(F.lit(1)), "any": lambda c: F.bool_or(F.col(c).cast("boolean")),
    "all": lambda c: F.bool_and(F.col(c).cast("boolean")), "range": lambda c: F.max(c) - F.min(c),
    # the smallest of the most frequent values
    "mode": lambda c: F.mode(c, True),
    **{f"q{p}": lambda c, p=p: F.percentile(c, p / 100) for p in (5, 10, 25, 50, 75, 90, 95)},
}


def _grouped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows that belong to a group: no key is null."""
    return df.na.drop(subset=list(by))


def group_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return _grouped(df, by).groupBy(*by).agg(F.avg(as_double(value)).alias("mean"))


def group_count(df: DataFrame, by: Sequence[str], value: str, ascending: bool = False) -> DataFrame:
    """Non-null values per group, sorted by count."""
    out = _grouped(df, by).groupBy(*by).agg(F.count(value).alias("n"))
    return out.orderBy(F.asc("n") if ascending else F.desc("n"), *by)


def group_share(df: DataFrame, by: Sequence[str], value: str, ascending: bool = False) -> DataFrame:
    """Count per group and its percentage of all counted values."""
    counted = _grouped(df, by).groupBy(*by).agg(F.count(value).alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))  # one row
    out = (counted.crossJoin(F.broadcast(total))
           .withColumn("percent", F.try_divide(F.col("n") * 100.0, F.col("_total"))).drop("_total"))
    return out.orderBy(F.asc("percent") if ascending else F.desc("percent"), *by)


def group_aggregate(df: DataFrame, by: Sequence[str], functions: dict[str, str | Sequence[str]],
                    order: Sequence[str] | None = None) -> DataFrame:
    """Any {column: function} per group; partial results are combined in Spark's own buffers.

    Besides AGGREGATES, `first` and `last` take the first and last present value along `order`.
    Quantiles, median and mode keep the distinct values of a group.
    """
    require_columns(df, [*by, *functions, *(order or [])])
    aggs = []
    at = F.struct(*(order or [F.lit(0)]))
    along = {"first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)),
             "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))}
    for c, names in functions.items():
        for name in [names] if isinstance(names, str) else names:
            if name in along and not order:
                raise ValueError(f"{name} needs order columns")
            known = {**AGGREGATES, **along}
            if name not in known:
                raise ValueError(f"unknown aggregate {name}; known: {sorted(known)}")
            aggs.append(known[name](c).alias(f"{c}_{name}"))
    return df.groupBy(*by).agg(*aggs)


def split_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """What is asked of the rows of one group, for all groups in one pass."""
    v = as_double(value)
    return (df.where(F.col(group).isNotNull() & v.isNotNull()).groupBy(group)
            .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                 F.min(v).alias("min"), F.max(v).alias("max")))


def crosstab(df: DataFrame, a: str, b: str, zeros: bool = False) -> DataFrame:
    """(a, b, n, expected) of every combination that occurs, with the count expected without association.

    Row and column totals are attached to the cells, so neither side has to be small. With `zeros` the
    combinations that do not occur are added; that grid has one row per pair of values.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a), F.col(b))
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    by_a, by_b = (cells.groupBy(c).agg(F.sum("n").alias("_s"), F.count(F.lit(1)).alias("_k")) for c in (a, b))
    if zeros:
        grid = by_a.select(a).crossJoin(by_b.select(b))
        cells = grid.join(cells, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
        by_a = by_a.crossJoin(by_b.agg(F.count(F.lit(1)).alias("_all"))).select(a, "_s", F.col("_all").alias("_k"))
    with_a = attach(cells, by_a.select(a, F.col("_s").alias("_r")), [a], by_a.select(a, F.col("_k").alias("n")))
    sizes = cells.groupBy(b).agg(F.count(F.lit(1)).alias("n"))
    with_b = attach(with_a, by_b.select(b, F.col("_s").alias("_c")), [b], sizes)
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_t")))  # one row
    return (with_b.crossJoin(total)
            .select(a, b, "n", (F.col("_r") * F.col("_c") / F.col("_t")).alias("expected")))
