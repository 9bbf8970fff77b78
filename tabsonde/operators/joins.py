"""Row alignment and attaching group statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.plans.ordering import attach
from tabsonde.schema import as_double, missing


def align_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where all of the columns are present: pairs sit on one row, so nothing is joined."""
    for c in cols:
        df = df.where(~missing(df, c))
    return df


def align_frames(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two tables with the same key."""
    return a.join(b, list(keys))


def keep_matching(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left_anti")


def attach_group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add the mean of each row's group and the row's z-score in it.

    Grouped statistics are joined back instead of windowed, so a group with a third of the
    rows is not sorted in one task. Rows with a null in a key belong to no group: their
    statistics are null.
    """
    v = as_double(value)
    v = F.when(reduce(and_, [F.col(c).isNotNull() for c in by]), v)
    stats = df.groupBy(*by).agg(F.avg(v).alias("group_mean"), F.stddev_samp(v).alias("_std"))
    return (attach(df, stats, by, df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
            .withColumn("z", F.try_divide(as_double(value) - F.col("group_mean"), "_std")).drop("_std"))
