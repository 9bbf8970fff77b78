"""Date detection, filters and type work on columns."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.plans.aggregates import column_stats
from tabsonde.plans.ordering import BUCKET, add_bucket, attach, running_sums
from tabsonde.schema import (categorical_columns, is_categorical, missing,
                             numeric_columns, require_columns)

DATE_NAME = re.compile("date|time", re.IGNORECASE)
INTEGER_TYPES = [("tinyint", -2**7, 2**7 - 1), ("smallint", -2**15, 2**15 - 1), ("int", -2**31, 2**31 - 1)]
WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def date_like_columns(df: DataFrame) -> list[str]:
    """Text columns whose name speaks of a date or time."""
    return [c for c in categorical_columns(df) if DATE_NAME.search(c)]


def detect_date_columns(df: DataFrame) -> DataFrame:
    """Turn date-like text columns into timestamps; unreadable values become null."""
    todo = set(date_like_columns(df))
    return df.select(*[F.try_to_timestamp(F.col(c)).alias(c) if c in todo else F.col(c) for c in df.columns])


def filter_date_range(df: DataFrame, ranges: dict[str, tuple[dt.date, dt.date]]) -> DataFrame:
    """Rows inside every range, both days included up to midnight of the next.

    Plain comparisons with literals, so they reach the Parquet scan.
    """
    require_columns(df, ranges)
    for c, (start, end) in ranges.items():
        kind = df.schema[c].dataType
        low, high = (F.lit(d.isoformat()).cast(kind) for d in (start, end + dt.timedelta(days=1)))
        df = df.where((F.col(c) >= low) & (F.col(c) < high))
    return df


def conversion_options(df: DataFrame) -> DataFrame:
    """Per column: distinct and missing values, and the types it could be converted to.

    Text converts to numeric or datetime when more than half of all rows parse, to category
    with under 50 distinct values that make up less than 30 % of the rows; numeric columns
    convert to category under 20 distinct values.
    """
    def measures(c: str) -> dict[str, Column]:
        t = df.schema[c].dataType
        v = F.when(~missing(df, c), F.col(c))
        text = is_categorical(t)
        zero = F.lit(0).cast("bigint")
        return {
            "type": F.first(F.lit(t.simpleString())), "n_rows": F.count(F.lit(1)),
            "n_unique": F.count_distinct(v), "n_missing": F.count_if(missing(df, c)),
            "_num": F.count_if(F.col(c).try_cast("double").isNotNull()) if text else zero + F.max(zero),
            "_ts": F.count_if(F.try_to_timestamp(F.col(c)).isNotNull()) if text else zero + F.max(zero)}

    text = F.col("type") == "string"
    numeric = F.col("type").isin("tinyint", "smallint", "int", "bigint", "float", "double")
    share = F.try_divide("n_unique", "n_rows")
    out = (column_stats(df, df.columns, measures)
           .withColumn("numeric_rate", F.when(text, F.try_divide("_num", "n_rows")))
           .withColumn("datetime_rate", F.when(text, F.try_divide("_ts", "n_rows")))
           .withColumn("to_numeric", F.coalesce(F.col("numeric_rate") > 0.5, F.lit(False)))
           .withColumn("to_datetime", F.coalesce(F.col("datetime_rate") > 0.5, F.lit(False)))
           .withColumn("to_category", F.coalesce(
               (text & (share < 0.3) & (F.col("n_unique") < 50)) | (numeric & (F.col("n_unique") < 20)),
               F.lit(False))))
    return out.drop("_num", "_ts")


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): distinct values numbered from 0 in alphabetical order.

    The numbers are running counts over ranges of the sorted values, so a dictionary of any
    size is numbered without sorting it in one task.
    """
    values = df.where(~missing(df, column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranged = add_bucket(values, [], [column], sample_from=df.where(~missing(df, column)))
    return (running_sums(ranged, [], [column], {"code": F.lit(1).cast("bigint")})
            .withColumn("code", F.col("code") - 1).drop(BUCKET))


def convert_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """Convert to numeric, datetime, string or category; values that do not fit become null.

    'category' adds `<column>_code` and keeps the text.
    """
    require_columns(df, [column])
    if target == "numeric":
        return df.withColumn(column, F.col(column).try_cast("double"))
    if target == "datetime":
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    if target == "string":
        return df.withColumn(column, F.col(column).cast("string"))
    if target == "category":
        codes = category_codes(df, column).drop("n").withColumnRenamed("code", f"{column}_code")
        sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return attach(df, codes, [column], sizes, unmatched=True).select(*df.columns, f"{column}_code")
    raise ValueError(f"unknown target type: {target}")


def narrowing_plan(df: DataFrame) -> DataFrame:
    """(column_name, from_type, to_type, n, saved_bytes) for every numeric column.

    Integers take the smallest type that holds min and max, doubles become float when every
    value survives the round trip. One scan for all columns.
    """
    cols = [c for c in numeric_columns(df) if df.schema[c].dataType.simpleString() in WIDTH]

    def measures(c: str) -> dict[str, Column]:
        name = df.schema[c].dataType.simpleString()
        if name in ("float", "double"):
            exact = F.coalesce(F.bool_and(F.isnan(c) | (F.col(c).cast("float").cast("double") == F.col(c))), F.lit(True))
            target = F.when(exact, "float").otherwise(name)
        else:
            target = F.lit(name)
            for t, lo, hi in reversed(INTEGER_TYPES):
                if WIDTH[t] < WIDTH[name]:
                    target = F.when((F.min(c) >= lo) & (F.max(c) <= hi), t).otherwise(target)
        return {"from_type": F.first(F.lit(name)), "to_type": target, "n": F.count(c)}

    width = F.create_map(*[F.lit(x) for kv in WIDTH.items() for x in kv])
    return column_stats(df, cols, measures).withColumn(
        "saved_bytes", (F.element_at(width, F.col("from_type")) - F.element_at(width, F.col("to_type")))
        * F.col("n"))


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the types of `narrowing_plan`, chosen over the whole table."""
    plan = {r["column_name"]: r["to_type"] for r in narrowing_plan(df).collect()}  # one row per column
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


def dictionary_candidates(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Text columns with the share of distinct values; below `limit` a dictionary pays."""
    return (column_stats(df, categorical_columns(df), lambda c: {
        "n_unique": F.count_distinct(c), "n_rows": F.count(F.lit(1))})
        .withColumn("unique_ratio", F.try_divide("n_unique", "n_rows"))
        .withColumn("use_dictionary", F.coalesce(F.col("unique_ratio") < limit, F.lit(False))))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.na.drop(subset=list(cols))


def optimise_table(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Narrow types, drop duplicate rows and, if asked, sort."""
    out = narrow_types(df).dropDuplicates()
    return out.orderBy(*order) if order else out


