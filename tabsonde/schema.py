"""Column roles, missing-value normalisation and input guards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_categorical(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def role_of(t: T.DataType) -> str:
    if is_numeric(t):
        return "numeric"
    if is_categorical(t):
        return "categorical"
    if is_temporal(t):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_categorical(f.dataType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_temporal(f.dataType)]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"unknown columns: {absent}; the table has {df.columns}")


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    names = list(names)
    require_columns(df, names)
    bad = [n for n in names if not is_numeric(df.schema[n].dataType)]
    if bad:
        raise ValueError(f"not numeric: {bad}")


def as_double(name: str) -> Column:
    """A numeric column as double with NaN turned into null."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null, decimals become double; other columns are untouched."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def missing(df: DataFrame, name: str) -> Column:
    """True where a value is null or NaN."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def rows_of(structs: Sequence[Column]) -> Column:
    """Explode a list of equally typed structs into rows of one column.

    The outer form, because for the inner one the optimizer adds a filter on the size of the
    array and thereby evaluates its elements twice.
    """
    return F.explode_outer(F.array(*structs)).alias("_r")


def spread(one_row: DataFrame, structs: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """Turn a wide aggregate (one row per `keep` key) into one row per struct."""
    return one_row.select(*keep, rows_of(structs)).select(*keep, "_r.*")
