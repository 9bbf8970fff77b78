"""Registry, table access, fixtures and rounding shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The parquet tables of one scale directory, and fixtures derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            sql, tables = FIXTURES[name]
            return self.spark.sql(sql.format(**{t: "{" + t + "}" for t in tables}),
                                  **{t: getattr(self, t) for t in tables})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# Expressions that run unchanged in Spark SQL and DuckDB.
FIXTURES: dict[str, tuple[str, list[str]]] = {
    "missing": ("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS discount_m,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax_mar,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS quantity_mcar,
  CASE WHEN l_orderkey % 20 <> 0 THEN NULL ELSE l_tax END AS tax_mostly,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_returnflag END AS flag_m
FROM {lineitem}""", ["lineitem"]),
    "dupes": ("SELECT * FROM {customer} UNION ALL SELECT * FROM {customer} WHERE c_custkey % 50 = 0",
              ["customer"]),
    "dirty": ("""SELECT o_orderkey,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END AS price_text,
  CASE WHEN o_orderkey % 13 = 0 THEN 'unknown'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date_text,
  o_orderstatus
FROM {orders}""", ["orders"]),
    "outliers": ("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price_o,
  CASE WHEN l_linenumber <= 5 THEN 0 ELSE l_quantity END AS quantity_zero
FROM {lineitem}""", ["lineitem"]),
    "segments": ("""SELECT event_id, value, event_type,
  CASE WHEN event_id % 10 < 8 THEN 'major'
       WHEN event_id % 250 = 9 THEN 'rare' ELSE 'minor' END AS segment
FROM {events}""", ["events"]),
    "series": ("""SELECT o_orderdate AS ts, o_totalprice AS y, o_orderstatus AS series FROM {orders}""", ["orders"]),
    "two_arm": ("""SELECT CASE WHEN l_linestatus = 'F' THEN 'control' ELSE 'treatment' END AS arm,
  l_extendedprice + CASE WHEN l_linestatus = 'O' THEN 1500 ELSE 0 END AS metric,
  l_quantity, l_returnflag
FROM {lineitem}""", ["lineitem"]),
    "two_by_two": ("""SELECT l_linestatus AS a,
  CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS b
FROM {lineitem}""", ["lineitem"]),
}


def fixture_sql(name: str) -> str:
    sql, tables = FIXTURES[name]
    return sql.format(**{t: t for t in tables}).replace("AS STRING", "AS VARCHAR")


def query(name: str, sql: str | None = None, **fixtures: str):
    """Register a query; `sql` may refer to fixtures by name, they are added as CTEs."""
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_fixtures(sql)
        return fn
    return add


def with_fixtures(sql: str) -> str:
    used = [n for n in FIXTURES if f"fx_{n}" in sql]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"fx_{n} AS ({fixture_sql(n)})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# Added before rounding means of money, which can end in an exact 5 (means of 32 prices do), so that
# both engines round them the same way.
NUDGE = 1e-7


def rounded(df: DataFrame, digits: int = 4, nudge: float = 0.0, **special: int) -> DataFrame:
    """Doubles rounded (no negative zero), integers as bigint, timestamps without zone."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(nudge), special.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def rnd(expr: str, digits: int = 4, nudge: float = 0.0) -> str:
    value = f"CAST({expr} AS DOUBLE)" + (f" + {nudge!r}::DOUBLE" if nudge else "")
    return f"(round({value}, {digits}) + 0.0)"


def union_all(items: Iterable[str], part: Callable[[str], str]) -> str:
    return "\nUNION ALL\n".join(part(i) for i in items)


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)
