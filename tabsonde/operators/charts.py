"""The aggregated rows behind charts: what is drawn has a fixed size, the table does not."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.functions.normal import norm_ppf
from tabsonde.operators.columns import category_codes
from tabsonde.operators.missing import missing_profile
from tabsonde.operators.profile import frequency_facts
from tabsonde.operators.regression import predictions, simple_regression, split_bucket
from tabsonde.plans.aggregates import column_stats, frequency_table
from tabsonde.plans.ordering import attach, ranked_frequency
from tabsonde.plans.quantiles import column_quantiles, grouped_quantiles
from tabsonde.schema import as_double, missing, numeric_columns, require_numeric

BINS = 30


def value_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    """{column: (min, max)} of the present values, None without values (one row)."""
    row = df.agg(*[e for i, c in enumerate(cols) for e in (F.min(as_double(c)).alias(f"l{i}"),
                                                          F.max(as_double(c)).alias(f"h{i}"))]).first()
    return {c: None if row[f"l{i}"] is None else (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(cols)}


def bin_number(c: str, span: tuple[float, float], bins: int) -> Column:
    """0 .. bins - 1; the maximum belongs to the last bin, a constant column to the first."""
    lo, hi = span
    if hi == lo:
        return F.when(as_double(c).isNotNull(), F.lit(0).cast("bigint"))
    return F.least(F.floor((as_double(c) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("bigint")


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = BINS,
              by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, bin, low, high, n) with edges shared by all groups; empty bins are left out."""
    cols = list(cols or numeric_columns(df))
    require_numeric(df, cols)
    spans = {c: s for c, s in value_ranges(df, cols).items() if s}
    if not spans:
        raise ValueError("no values to count")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), bin_number(c, s, bins).alias("bin"),
                               F.lit(s[0]).alias("_lo"), F.lit((s[1] - s[0]) / bins).alias("_w"))
                      for c, s in spans.items()])
    counted = (df.select(*by, F.explode_outer(cells).alias("c")).where("c.bin IS NOT NULL")
               .groupBy(*by, "c.column_name", "c.bin", "c._lo", "c._w").agg(F.count(F.lit(1)).alias("n")))
    return counted.select(*by, "column_name", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
                          (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")


def box(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, q1, median, q3, whisker_low, whisker_high, n_outside)."""
    cols = list(cols or numeric_columns(df))
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    cols = [c for c in cols if q[c, 0.5] is not None]

    def measures(c: str) -> dict[str, Column]:
        q1, q3 = q[c, 0.25], q[c, 0.75]
        inside = as_double(c).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        return {"q1": F.first(F.lit(q1)), "median": F.first(F.lit(q[c, 0.5])), "q3": F.first(F.lit(q3)),
                "whisker_low": F.min(F.when(inside, as_double(c))), "whisker_high": F.max(F.when(inside, as_double(c))),
                "n_outside": F.count_if(~inside)}
    return column_stats(df, cols, measures)


def box_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, min, q1, median, q3, max) per group."""
    q = grouped_quantiles(df.where(F.col(group).isNotNull()), [group], [value],
                          {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})
    return q.drop("column_name")


def category_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n, percent) of a pie chart."""
    freq = frequency_table(df, cols)
    total = F.broadcast(frequency_facts(freq).select("column_name", "total"))  # one row per column
    return (freq.join(total, "column_name").withColumn("percent", F.col("n") * 100 / F.col("total")).drop("total")
            .orderBy("column_name", F.desc("n"), "value"))


def treemap(df: DataFrame, path: Sequence[str]) -> DataFrame:
    """(path, n): the size of every leaf."""
    present = df
    for c in path:
        present = present.where(~missing(df, c))
    return present.groupBy(*path).agg(F.count(F.lit(1)).alias("n"))


def scatter_density(df: DataFrame, x: str, y: str, bins: int = BINS, by: Sequence[str] = ()) -> DataFrame:
    """(by, x_bin, y_bin, n, x_mean, y_mean): points counted on a grid."""
    require_numeric(df, [x, y])
    pairs = df.where(~missing(df, x) & ~missing(df, y))
    spans = value_ranges(pairs, [x, y])
    if spans[x] is None:
        raise ValueError("no pair of values")
    return (pairs.groupBy(*by, bin_number(x, spans[x], bins).alias("x_bin"), bin_number(y, spans[y], bins).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(as_double(x)).alias("x_mean"), F.avg(as_double(y)).alias("y_mean")))


def scatter_density_3d(df: DataFrame, axes: Sequence[str], bins: int = BINS, by: Sequence[str] = ()) -> DataFrame:
    """(by, x_bin, y_bin, z_bin, n, x_mean, y_mean, z_mean): all points, counted on a grid of three axes."""
    require_numeric(df, axes)
    rows = df.where(reduce(and_, [~missing(df, a) for a in axes]))
    spans = value_ranges(rows, axes)
    if spans[axes[0]] is None:
        raise ValueError("no complete row")
    names = ["x", "y", "z"]
    return (rows.groupBy(*by, *[bin_number(a, spans[a], bins).alias(f"{n}_bin") for n, a in zip(names, axes, strict=True)])
            .agg(F.count(F.lit(1)).alias("n"), *[F.avg(as_double(a)).alias(f"{n}_mean") for n, a in zip(names, axes, strict=True)]))


def scatter_sample(df: DataFrame, axes: Sequence[str], key: Sequence[str], points: int | None = None,
                   extra: Sequence[str] = ()) -> DataFrame:
    """The complete rows as points; if asked for, about `points` of them picked by a hash of their key: the same
    rows on every run.

    Two or three axes; `extra` names the columns for colour, size or hover text.
    """
    require_numeric(df, axes)
    rows = df
    for a in axes:
        rows = rows.where(~missing(df, a))
    if points is not None:
        total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
        rows = rows.where(split_bucket(key, 11, 1 << 20) * total < F.lit(points * (1 << 20)))
    return rows.select(*key, *[c for c in [*axes, *extra] if c not in key])


def scatter_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the fitted line and its two end points."""
    pairs = df.where(~missing(df, x) & ~missing(df, y))
    ends = pairs.agg(F.min(as_double(x)).alias("x_1"), F.max(as_double(x)).alias("x_2"))
    fit = simple_regression(df, x, y).select("n", "slope", "intercept")
    at = lambda v: F.col("intercept") + F.col("slope") * F.col(v)
    return fit.crossJoin(ends).select("n", "slope", "intercept", "x_1", at("x_1").alias("y_1"), "x_2", at("x_2").alias("y_2"))


def pair_grid(df: DataFrame, cols: Sequence[str], bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by, x_column, y_column, x_bin, y_bin, n) for all pairs of columns in one job."""
    require_numeric(df, cols)
    spans = {c: s for c, s in value_ranges(df, cols).items() if s}
    cells = F.array(*[F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"),
                               bin_number(a, spans[a], bins).alias("x_bin"), bin_number(b, spans[b], bins).alias("y_bin"))
                      for a, b in combinations(spans, 2)])
    return (df.select(*by, F.explode_outer(cells).alias("c")).where("c.x_bin IS NOT NULL AND c.y_bin IS NOT NULL")
            .groupBy(*by, "c.x_column", "c.y_column", "c.x_bin", "c.y_bin").agg(F.count(F.lit(1)).alias("n")))


def density(df: DataFrame, cols: Sequence[str], bins: int = 100, points: int = 50) -> DataFrame:
    """(column_name, x, density): Gaussian kernel density with Scott's bandwidth.

    Evaluated from bins instead of rows: bins x points terms per column.
    """
    require_numeric(df, cols)
    spans = value_ranges(df, cols)
    facts = column_stats(df, cols, lambda c: {"m": F.count(as_double(c)), "sd": F.stddev_samp(as_double(c))})
    grid = F.array(*[F.struct(F.lit(c).alias("k"), F.lit(s[0]).alias("lo"), F.lit((s[1] - s[0]) / (points - 1)).alias("w"))
                     for c, s in spans.items() if s])
    one = F.element_at(F.filter(grid, lambda g: g["k"] == F.col("column_name")), 1)
    h = histogram(df, cols, bins).join(F.broadcast(facts), "column_name").where("sd > 0").withColumn("g", one)
    h = h.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("g.lo") + F.col("i") * F.col("g.w"))
    width = F.col("sd") * F.pow(F.col("m"), F.lit(-0.2))
    u = (F.col("x") - (F.col("low") + F.col("high")) / 2) / width
    return (h.groupBy("column_name", "i", "x")
            .agg(F.sum(F.col("n") * F.exp(-u * u / 2) / (F.col("m") * width * F.sqrt(2 * F.pi()))).alias("density"))
            .select("column_name", "x", "density"))


RANKS = 1_000_000  # of one value that are made at once


def qq_points(df: DataFrame, column: str, points: int | None = None) -> DataFrame:
    """(i, theoretical, sample): normal quantile of (i - 0.5) / n against the i-th smallest value.

    Every rank, or `points` ranks spread evenly over the n rows.
    """
    require_numeric(df, [column])
    ranked = ranked_frequency(df.select(as_double(column).alias("v")), "v")
    n, start = F.col("n_group"), F.col("upto") - F.col("n")
    if points is None:  # in stretches: an array cannot hold all ranks of a very frequent value
        ranked = ranked.select("v", "n_group", "upto", F.explode(F.sequence(start + 1, F.col("upto"), F.lit(RANKS))).alias("_from"))
        picks = F.sequence("_from", F.least(F.col("_from") + RANKS - 1, F.col("upto")))
    else:
        # Ranks ceil((j - 0.5) * n / points) for j = 1 .. points that this value holds.
        rank = lambda j: F.ceil((j - 0.5) * n / points)
        first = F.floor(start * points / n + 0.5) - 1
        last = F.ceil(F.col("upto") * points / n + 0.5) + 1
        js = F.sequence(F.greatest(first, F.lit(1)), F.least(last, F.lit(points).cast("bigint")))
        js = F.when(F.greatest(first, F.lit(1)) <= F.least(last, F.lit(points).cast("bigint")), js)
        picks = F.array_distinct(F.filter(F.transform(js, rank), lambda i: (i > start) & (i <= F.col("upto"))))
    out = ranked.select("v", "n_group", F.explode(picks).alias("i"))
    return out.select("i", norm_ppf((F.col("i") - 0.5) / F.col("n_group")).alias("theoretical"), F.col("v").alias("sample"))


def residuals(df: DataFrame, predictors: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, actual, fitted, residual) for every complete row."""
    return predictions(df, predictors, target, keep)


def residual_histogram(df: DataFrame, predictors: Sequence[str], target: str, bins: int = BINS) -> DataFrame:
    return histogram(predictions(df, predictors, target), ["residual"], bins)


def predicted_against_actual(df: DataFrame, predictors: Sequence[str], target: str, bins: int = BINS) -> DataFrame:
    """(x_bin, y_bin, n, x_mean, y_mean) with the actual value on x and the fitted one on y."""
    return scatter_density(predictions(df, predictors, target), "actual", "fitted", bins)


def parallel_axes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, kind, low, high, label): range of numeric axes, one row per label of the others.

    Labels and codes are both in alphabetical order.
    """
    numeric = [c for c in cols if c in numeric_columns(df)]
    out = None
    if numeric:
        out = column_stats(df, numeric, lambda c: {"low": F.min(as_double(c)), "high": F.max(as_double(c))}).select(
            "column_name", F.lit("range").alias("kind"), "low", "high", F.lit(None).cast("string").alias("label"))
    for c in (c for c in cols if c not in numeric):
        code = F.col("code").cast("double")
        part = category_codes(df, c).select(F.lit(c).alias("column_name"), F.lit("label").alias("kind"),
                                            code.alias("low"), code.alias("high"), F.col(c).cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def parallel_lines(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows with numbers as they are and other columns as alphabetical codes."""
    out = df.select(*keep, *[c for c in cols if c not in keep])
    for c in cols:
        if c in numeric_columns(df):
            continue
        sizes = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        out = (attach(out, category_codes(df, c).drop("n"), [c], sizes, unmatched=True)
               .drop(c).withColumnRenamed("code", c))
    return out.select(*keep, *[c for c in cols if c not in keep])


def missing_matrix(df: DataFrame, limit: int | None = None) -> DataFrame:
    """(pattern columns, n_rows): which columns are missing together, 1 for missing.

    All columns, or with `limit` that many of those with most missing values.
    """
    cols = df.columns
    if limit is not None and len(cols) > limit:
        top = missing_profile(df).limit(limit).collect()
        cols = [c for c in cols if c in {r["column_name"] for r in top}]
    return df.groupBy(*[missing(df, c).cast("bigint").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("n_rows"))
