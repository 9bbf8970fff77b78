"""Column roles, descriptive statistics, frequencies and size of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.plans.aggregates import column_stats, frequency_table
from tabsonde.plans.quantiles import column_quantiles
from tabsonde.schema import (FIXED_WIDTH, as_double, categorical_columns, missing, numeric_columns,
                             require_columns, require_numeric, role_of, temporal_columns)

CATEGORY_LIMIT = 30


def _present(df: DataFrame, c: str) -> Column:
    return F.count_if(~missing(df, c))


def roles_by_type(df: DataFrame) -> DataFrame:
    """(column_name, type, role, non_null) for every column."""
    kind = {f.name: f.dataType for f in df.schema}
    return column_stats(df, df.columns, lambda c: {
        "type": F.first(F.lit(kind[c].simpleString())),
        "role": F.first(F.lit(role_of(kind[c]))),
        "non_null": _present(df, c)})


def roles_by_cardinality(df: DataFrame, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Strings and columns with at most `limit` distinct values (null counts) are categorical."""
    text = set(categorical_columns(df))
    counted = column_stats(df, df.columns, lambda c: {
        "n_unique": F.count_distinct(c) + F.max(missing(df, c).cast("int"))})
    role = F.when(F.col("column_name").isin(*text) if text else F.lit(False), "categorical") \
        .when(F.col("n_unique") <= limit, "categorical").otherwise("continuous")
    return counted.select("column_name", "n_unique", role.alias("role"))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """n, mean, sample std, min, quartiles and max of numeric columns, one row each."""
    cols = list(cols or numeric_columns(df))
    require_numeric(df, cols)
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75])

    def quartile(p: float) -> Column:
        out = F.lit(None).cast("double")
        for c in cols:
            out = F.when(F.col("column_name") == c, F.lit(q[c, p])).otherwise(out)
        return out

    stats = column_stats(df, cols, lambda c: {
        "n": F.count(as_double(c)), "mean": F.avg(as_double(c)), "std": F.stddev_samp(as_double(c)),
        "min": F.min(as_double(c)), "max": F.max(as_double(c))})
    return stats.select("column_name", "n", "mean", "std", "min", quartile(0.25).alias("q25"),
                        quartile(0.5).alias("median"), quartile(0.75).alias("q75"), "max")


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n), most frequent first."""
    cols = list(cols or categorical_columns(df))
    require_columns(df, cols)
    return frequency_table(df, cols).orderBy("column_name", F.desc("n"), "value")


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values per column; every task keeps only its own best k."""
    cols = list(cols or categorical_columns(df))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (frequency_table(df, cols).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def frequency_facts(freq: DataFrame) -> DataFrame:
    """Per column of a frequency table: distinct values, rows, and the mode (ties: smallest)."""
    return (freq.groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("total"),
                 F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v"))).alias("best"))
            .select("column_name", "n_unique", "total", F.col("best.v").alias("mode"),
                    (-F.col("best.m")).alias("mode_n")))


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Distinct values and mode of every categorical column with its k most frequent values."""
    cols = list(cols or categorical_columns(df))
    freq = frequency_table(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    top = freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # One fact row per column of the table.
    return (top.join(F.broadcast(frequency_facts(freq)), "column_name")
            .select("column_name", "n_unique", "mode", "mode_n", "rank", "value", "n"))


def count_distinct(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    cols = list(cols or df.columns)
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return column_stats(df, cols, lambda c: {"n_unique": fn(F.when(~missing(df, c), F.col(c)))})


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: shape, missing cells and number of columns by role."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    total = sum((F.col(f"_m{i}") for i in range(len(cols))), F.lit(0).cast("bigint"))
    return row.select(
        "n_rows", F.lit(len(cols)).cast("bigint").alias("n_columns"), total.alias("missing_cells"),
        (F.coalesce(F.try_divide(total, F.col("n_rows") * len(cols)), F.lit(0.0)) * 100).alias("missing_percent"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("categorical_columns"),
        F.lit(len(temporal_columns(df))).cast("bigint").alias("datetime_columns"))


def type_distribution(df: DataFrame) -> DataFrame:
    """(type, n_columns, non_null): columns per type and the values they hold."""
    return (roles_by_type(df).groupBy("type")
            .agg(F.count(F.lit(1)).alias("n_columns"), F.sum("non_null").alias("non_null")))


def column_bytes(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(c).cast("bigint")), F.lit(0))
    width = FIXED_WIDTH.get(type(t))
    if width is None:
        raise ValueError(f"no fixed width for {c}: {t.simpleString()}")
    return F.count(c) * F.lit(width).cast("bigint")


def memory_footprint(df: DataFrame) -> DataFrame:
    """Bytes of the values of every column, null excluded, without object overhead."""
    return column_stats(df, df.columns, lambda c: {"bytes": column_bytes(df, c)})


def corrected_skewness(v: Column) -> Column:
    """Bias-corrected sample skewness; null under three values or without spread."""
    n = F.count(v)
    return F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


def skewness_profile(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 2.0) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return (column_stats(df, cols, lambda c: {
        "n": F.count(as_double(c)), "skewness": corrected_skewness(as_double(c))})
        .withColumn("is_skewed", F.coalesce(F.abs("skewness") > limit, F.lit(False))))


def zero_ratio(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.5) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return (column_stats(df, cols, lambda c: {
        "zeros": F.count_if(F.col(c) == 0), "n_rows": F.count(F.lit(1))})
        .withColumn("zero_ratio", F.try_divide("zeros", "n_rows"))
        .withColumn("mostly_zero", F.coalesce(F.col("zero_ratio") > limit, F.lit(False))))


def list_unique_values(df: DataFrame, cols: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    """All distinct values of columns that have at most `limit` of them."""
    cols = list(cols or categorical_columns(df))
    w = Window.partitionBy("column_name").orderBy("value")
    # limit + 1 values per column are enough to see that there are too many.
    some = (frequency_table(df, cols).withColumn("k", F.row_number().over(w))
            .where(F.col("k") <= limit + 1))
    return (some.groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("n_unique"), F.array_sort(F.collect_list("value")).alias("v"))
            .where(F.col("n_unique") <= limit)
            .select("column_name", "n_unique", F.concat_ws("|", "v").alias("unique_values")))


def preview_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows along `order`, date columns as text to the second."""
    out = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in temporal_columns(df) else F.col(c)
           for c in df.columns]
    return df.orderBy(*order).limit(n).select(*out)


def sample_values(df: DataFrame, order: Sequence[str], cols: Sequence[str] | None = None,
                  n: int = 5) -> DataFrame:
    """(column_name, position, value): first n non-null values per column along `order`."""
    cols = list(cols or df.columns)
    cells = F.explode_outer(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                         F.when(~missing(df, c), F.col(c)).cast("string").alias("value"))
                                for c in cols]))
    keys = [f"_k{i}" for i in range(len(order))]
    long = (df.select(*[F.col(o).alias(k) for o, k in zip(order, keys)], cells.alias("c"))
            .select(*keys, "c.*").where(F.col("value").isNotNull()))
    w = Window.partitionBy("column_name").orderBy(*keys)
    return (long.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
            .select("column_name", "position", "value"))


def memory_total(df: DataFrame) -> DataFrame:
    return memory_footprint(df).agg(F.sum("bytes").alias("bytes"))
