"""Aggregates shared by many operators: wide statistics, frequency table, pair sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsonde.schema import as_double, spread

# One aggregate over more columns than this leaves whole-stage code generation.
COLUMNS_PER_AGGREGATE = 60

Measures = Callable[[str], dict[str, Column]]


def column_stats(df: DataFrame, cols: Sequence[str], measures: Measures,
                 by: Sequence[str] = ()) -> DataFrame:
    """One scan, one row per (by, column): `measures(c)` names the aggregates of c."""
    parts = []
    for start in range(0, len(cols), COLUMNS_PER_AGGREGATE):
        chunk = list(cols[start:start + COLUMNS_PER_AGGREGATE])
        aggs, structs = [], []
        for i, c in enumerate(chunk):
            fields = [F.lit(c).alias("column_name")]
            for name, expr in measures(c).items():
                aggs.append(expr.alias(f"_{i}_{name}"))
                fields.append(F.col(f"_{i}_{name}").alias(name))
            structs.append(F.struct(*fields))
        wide = df.groupBy(*by).agg(*aggs)
        parts.append(spread(wide, structs, by))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpivot_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                   numeric: bool = False) -> DataFrame:
    """(by, column_name, value) with one row per cell, missing cells dropped."""
    cell = as_double if numeric else (lambda c: F.col(c).cast("string"))
    structs = [F.struct(F.lit(c).alias("column_name"), cell(c).alias("value")) for c in cols]
    return spread(df, structs, by).where(F.col("value").isNotNull())


def frequency_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, value, n): the count of every distinct value of every column.

    Counts are combined on the map side, so a value that fills a third of the table
    costs one shuffled row per task.
    """
    return (unpivot_values(df, cols, by)
            .groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def pearson(sxy: Column, sxx: Column, syy: Column) -> Column:
    """r from centred sums; null when either side is constant."""
    return F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))


def pair_sums(x: Column, y: Column) -> dict[str, Column]:
    """Centred sums of a pair over rows where both are present."""
    return {
        "n": F.regr_count(y, x),
        "mean_x": F.regr_avgx(y, x),
        "mean_y": F.regr_avgy(y, x),
        "sxx": F.regr_sxx(y, x),
        "syy": F.regr_syy(y, x),
        "sxy": F.regr_sxy(y, x),
    }
