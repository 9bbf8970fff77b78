"""Missing values: profile, pattern and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.plans.aggregates import column_stats
from tabsonde.plans.ordering import add_bucket, carry, running_sums
from tabsonde.plans.quantiles import column_quantiles
from tabsonde.schema import as_double, missing, normalise, numeric_columns, require_columns, require_numeric, spread


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_missing, percent) for columns with a missing value, most first."""
    cols = list(cols or df.columns)
    return (column_stats(df, cols, lambda c: {
        "n_missing": F.count_if(missing(df, c)), "n_rows": F.count(F.lit(1))})
        .where(F.col("n_missing") > 0)
        .select("column_name", "n_missing", (F.col("n_missing") / F.col("n_rows") * 100).alias("percent"))
        .orderBy(F.desc("n_missing"), "column_name"))


def missing_pattern(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, ratio, max_corr, pattern) for columns with a missing value.

    A heuristic, not a test: the null flag of a column is correlated with the presence flags
    of the other numeric columns that hold more than ten values. Above 90 % missing the
    label is mostly_missing, else the largest absolute correlation decides: under 0.1 MCAR,
    over 0.3 MAR, between MNAR. One scan finds the columns with missing values, one more
    counts all pairs of their flags.
    """
    cols = list(cols or df.columns)
    numeric = numeric_columns(df)
    names = list(dict.fromkeys([*cols, *numeric]))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    some = {c for i, c in enumerate(names) if counts[f"m{i}"]}
    # A column without missing values has a constant flag, so it takes part in no pair.
    cols = [c for c in cols if c in some]
    numeric = [c for c in numeric if c in some]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, ratio double, max_corr double, pattern string")
    flags = df.select(*[missing(df, c).cast("bigint").alias(c) for c in names if c in some])
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(f"m_{c}") for c in flags.columns]
    pairs = [(c, o) for c in cols for o in numeric if o != c]
    aggs += [F.sum(F.col(c) * (1 - F.col(o))).alias(f"x_{c}_{o}") for c, o in pairs]
    row = flags.agg(*aggs)
    n = F.col("n").cast("double")
    structs = []
    for c in cols:
        m = F.col(f"m_{c}")
        rs = [F.lit(None).cast("double")]
        for o in (o for k, o in pairs if k == c):
            p = n - F.col(f"m_{o}")
            cov = F.col(f"x_{c}_{o}") * n - m * p
            r = F.try_divide(F.abs(cov), F.sqrt(m * (n - m)) * F.sqrt(p * (n - p)))
            rs.append(F.when(p > 10, r))
        structs.append(F.struct(F.lit(c).alias("column_name"), F.try_divide(m, n).alias("ratio"),
                                F.array_max(F.array(*rs)).alias("max_corr")))
    label = (F.when(F.col("ratio") > 0.9, "mostly_missing")
             .when(F.col("max_corr").isNull(), "unavailable")
             .when(F.col("max_corr") < 0.1, "MCAR")
             .when(F.col("max_corr") > 0.3, "MAR").otherwise("MNAR"))
    return spread(row, structs).where(F.col("ratio") > 0).withColumn("pattern", label)


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols or df.columns))


def _keep_types(df: DataFrame, filled: dict[str, Column]) -> DataFrame:
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def fill_carried(df: DataFrame, cols: Sequence[str], order: Sequence[str], by: Sequence[str] = (),
                 forward: bool = True) -> DataFrame:
    """Fill with the previous (or next) value along a unique `order`, within `by` if given."""
    require_columns(df, [*cols, *order, *by])
    df = normalise(df)
    got = carry(add_bucket(df, by, order), by, order, {f"_f_{c}": F.col(c) for c in cols}, forward)
    return got.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_numeric(df, cols)
    df = normalise(df)
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])  # one row
    joined = df.crossJoin(F.broadcast(means))
    return joined.select(*[F.coalesce(F.col(c).cast("double"), f"_m_{c}").alias(c) if c in cols else F.col(c)
                           for c in df.columns])


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_numeric(df, cols)
    q = column_quantiles(df, cols, [0.5])
    return _keep_types(df, {c: F.coalesce(as_double(c), F.lit(q[c, 0.5]).cast("double")) for c in cols})


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row `_m_<column>` with the most frequent value of each column, the smallest on ties.

    One frequency table serves all columns: a cell has a field for each type, of which one is filled.
    """
    kinds = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c in cols))
    own = [kinds.index(df.schema[c].dataType.simpleString()) for c in cols]
    cells = [F.struct(F.lit(i).alias("c"), *[(F.when(~missing(df, c), F.col(c)) if k == own[i] else F.lit(None).cast(kind)).alias(f"v{k}")
                                             for k, kind in enumerate(kinds)]) for i, c in enumerate(cols)]
    values = [f"v{k}" for k in range(len(kinds))]
    counted = (spread(df, cells).where(F.coalesce(*[F.col(v).isNotNull().cast("int") if len(values) == 1 else
                                                    F.when(F.col(v).isNotNull(), 1) for v in values]) == 1)
               .groupBy("c", *values).agg(F.count(F.lit(1)).alias("n")))
    best = counted.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("m"), *values)).alias("b"))
    return best.agg(*[F.first(F.when(F.col("c") == i, F.col(f"b.v{own[i]}")), ignorenulls=True).alias(f"_m_{c}")
                      for i, c in enumerate(cols)])


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    df = normalise(df)
    out = df.crossJoin(F.broadcast(column_modes(df, cols)))  # one row
    return out.select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, cols: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Linear by row position along a unique `order`; leading nulls stay, trailing ones take
    the last value."""
    require_numeric(df, cols)
    names = df.columns
    rows = running_sums(add_bucket(normalise(df), by, order), by, order, {"_pos": F.lit(1).cast("bigint")})

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).cast("double").alias("v")))

    rows = carry(rows, by, order, {f"_a_{c}": known(c) for c in cols}, forward=True)
    rows = carry(rows, by, order, {f"_b_{c}": known(c) for c in cols}, forward=False)

    def value(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        between = a["v"] + F.try_divide((b["v"] - a["v"]) * (F.col("_pos") - a["p"]), b["p"] - a["p"])
        return (F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(a.isNull(), F.lit(None))
                .when(b.isNull(), a["v"]).otherwise(between))

    return rows.select(*[value(c).alias(c) if c in cols else F.col(c) for c in names])


def fill_missing(df: DataFrame, method: str, cols: Sequence[str], order: Sequence[str] = (),
                 by: Sequence[str] = ()) -> DataFrame:
    """One entry for all repairs: drop, forward_fill, backward_fill, mean, median, mode, interpolate."""
    if method in ("forward_fill", "backward_fill", "interpolate") and not order:
        raise ValueError(f"{method} needs the columns that order the rows")
    if method == "drop":
        return drop_missing(df, cols)
    if method == "forward_fill":
        return fill_carried(df, cols, order, by, True)
    if method == "backward_fill":
        return fill_carried(df, cols, order, by, False)
    if method == "mean":
        return fill_mean(df, cols)
    if method == "median":
        return fill_median(df, cols)
    if method == "mode":
        return fill_mode(df, cols)
    if method == "interpolate":
        return interpolate(df, cols, order, by)
    raise ValueError(f"unknown method: {method}")
