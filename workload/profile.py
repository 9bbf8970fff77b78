"""Profiling and column queries."""

from __future__ import annotations

import datetime as dt

from tabsonde.operators import columns as C
from tabsonde.operators import profile as P
from tabsonde.operators import grouping as G
from tabsonde.sources import readers
from workload.common import LINE_NUMERIC, LINE_ORDER, query, rnd, rounded, union_all

ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
LINE_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
              "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
              "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
WIDTH = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}


def role(t: str) -> str:
    return {"string": "categorical", "timestamp_ntz": "datetime"}.get(t, "numeric")


def describe_sql(cols, table="lineitem") -> str:
    return union_all(cols, lambda c: f"""SELECT '{c}' AS column_name, count({c}) AS n, {rnd(f'avg({c})')} AS mean,
  {rnd(f'stddev_samp({c})')} AS std, {rnd(f'min({c})')} AS min, {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS q25,
  {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median, {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS q75,
  {rnd(f'max({c})')} AS max FROM {table}""")


def counts_sql(cols, table) -> str:
    return union_all(cols, lambda c: f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n "
                                     f"FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}")


@query("describe_numeric", describe_sql(LINE_NUMERIC))
def describe_numeric(t):
    return rounded(P.describe_numeric(t.lineitem, LINE_NUMERIC))


@query("src_frame", "SELECT * FROM supplier")
def src_frame(t):
    return readers.load(t.supplier)


@query("column_roles_dtype", union_all(ORDERS_TYPES, lambda c: (
    f"SELECT '{c}' AS column_name, '{ORDERS_TYPES[c]}' AS type, '{role(ORDERS_TYPES[c])}' AS role, "
    f"count({c}) AS non_null FROM orders")))
def column_roles_dtype(t):
    return P.roles_by_type(t.orders)


@query("column_roles_cardinality", union_all(LINE_TYPES, lambda c: (
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, CASE WHEN '{LINE_TYPES[c]}' = 'string' "
    f"OR count(DISTINCT {c}) <= 30 THEN 'categorical' ELSE 'continuous' END AS role FROM lineitem")))
def column_roles_cardinality(t):
    return P.roles_by_cardinality(t.lineitem)


@query("value_counts", counts_sql(["o_orderstatus", "o_orderpriority"], "orders"))
def value_counts(t):
    return P.value_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


TOP = f"""WITH f AS ({counts_sql(['p_brand', 'p_type', 'p_name'], 'part')}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM f)"""


@query("top_k_values", TOP + " SELECT column_name, value, n, rank FROM r WHERE rank <= 5")
def top_k_values(t):
    return rounded(P.top_values(t.part, ["p_brand", "p_type", "p_name"]))


@query("describe_categorical", TOP + """, u AS (SELECT column_name, count(*) AS n_unique,
 max(CASE WHEN rank = 1 THEN value END) AS mode, max(n) AS mode_n FROM r GROUP BY column_name)
SELECT r.column_name, n_unique, mode, mode_n, rank, value, n FROM r JOIN u ON r.column_name = u.column_name WHERE rank <= 5""")
def describe_categorical(t):
    return rounded(P.describe_categorical(t.part, ["p_brand", "p_type", "p_name"]))


@query("count_distinct", union_all(LINE_TYPES, lambda c: (
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM lineitem")))
def count_distinct(t):
    return P.count_distinct(t.lineitem)


MISSING_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                "discount_m", "tax_mar", "quantity_mcar", "tax_mostly", "flag_m"]
ALL_MISSING = " + ".join(f"count(*) - count({c})" for c in MISSING_COLS)


@query("dataset_summary", f"""SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, {ALL_MISSING} AS missing_cells,
 {rnd(f'({ALL_MISSING}) / (count(*) * 11.0) * 100')} AS missing_percent, CAST(10 AS BIGINT) AS numeric_columns,
 CAST(1 AS BIGINT) AS categorical_columns, CAST(0 AS BIGINT) AS datetime_columns FROM fx_missing""")
def dataset_summary(t):
    return rounded(P.dataset_summary(t.missing))


@query("dtype_distribution", "SELECT type, count(*) AS n_columns, CAST(sum(n) AS BIGINT) AS non_null FROM ("
       + union_all(LINE_TYPES, lambda c: f"SELECT '{LINE_TYPES[c]}' AS type, count({c}) AS n FROM lineitem")
       + ") GROUP BY type")
def dtype_distribution(t):
    return P.type_distribution(t.lineitem)


@query("memory_footprint", union_all(LINE_TYPES, lambda c: (
    f"SELECT '{c}' AS column_name, CAST(" + (f"sum(strlen({c}))" if LINE_TYPES[c] == "string" else
                                             f"count({c}) * {WIDTH[LINE_TYPES[c]]}") + " AS BIGINT) AS bytes FROM lineitem")))
def memory_footprint(t):
    return P.memory_footprint(t.lineitem)


SKEW_COLS = ["l_extendedprice", "price_o", "quantity_zero"]


@query("skewness_profile", union_all(SKEW_COLS, lambda c: (
    f"SELECT '{c}' AS column_name, count({c}) AS n, {rnd(f'skewness({c})')} AS skewness, "
    f"abs(skewness({c})) > 2 AS is_skewed FROM fx_outliers")))
def skewness_profile(t):
    return rounded(P.skewness_profile(t.outliers, SKEW_COLS))


@query("zero_ratio", union_all(["l_linenumber", "l_discount", "l_tax", "quantity_zero"], lambda c: f"""SELECT '{c}' AS column_name,
 count(*) FILTER ({c} = 0) AS zeros, count(*) AS n_rows, {rnd(f'count(*) FILTER ({c} = 0) / count(*)')} AS zero_ratio,
 count(*) FILTER ({c} = 0) / count(*) > 0.5 AS mostly_zero
 FROM (SELECT *, CASE WHEN l_linenumber <= 5 THEN 0 ELSE l_quantity END AS quantity_zero FROM lineitem)"""))
def zero_ratio(t):
    df = t.lineitem.selectExpr("*", "CASE WHEN l_linenumber <= 5 THEN 0 ELSE l_quantity END AS quantity_zero")
    return rounded(P.zero_ratio(df, ["l_linenumber", "l_discount", "l_tax", "quantity_zero"]))


@query("list_unique_values", union_all(["l_returnflag", "l_linestatus"], lambda c: f"""SELECT '{c}' AS column_name,
 count(DISTINCT {c}) AS n_unique, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM lineitem)) AS unique_values
 FROM lineitem"""))
def list_unique_values(t):
    df = t.lineitem.selectExpr("l_returnflag", "l_linestatus", "CAST(l_orderkey AS STRING) AS order_text")
    return P.list_unique_values(df)


@query("preview_rows", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5""")
def preview_rows(t):
    return P.preview_rows(t.orders, ["o_orderkey"])


SAMPLE_COLS = ["discount_m", "tax_mostly", "flag_m", "l_quantity"]


@query("sample_values", union_all(SAMPLE_COLS, lambda c: f"""SELECT * FROM (SELECT '{c}' AS column_name,
 row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS position, CAST({c} AS VARCHAR) AS value
 FROM fx_missing WHERE {c} IS NOT NULL) WHERE position <= 5"""))
def sample_values(t):
    return rounded(P.sample_values(t.missing, LINE_ORDER, SAMPLE_COLS))


@query("detect_date_columns", """SELECT o_orderkey, price_text, TRY_CAST(order_date_text AS TIMESTAMP) AS order_date_text,
 o_orderstatus FROM fx_dirty""")
def detect_date_columns(t):
    return rounded(C.detect_date_columns(t.dirty))


@query("filter_date_range", """SELECT event_id, ts, value FROM events
 WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""")
def filter_date_range(t):
    return C.filter_date_range(t.events, {"ts": (dt.date(2024, 1, 5), dt.date(2024, 1, 12))}).select(
        "event_id", "ts", "value")


def options_sql() -> str:
    parts = []
    for c, kind in {"o_orderkey": "bigint", "price_text": "string", "order_date_text": "string",
                    "o_orderstatus": "string"}.items():
        text = kind == "string"
        num = f"count(TRY_CAST({c} AS DOUBLE)) / count(*)" if text else "NULL"
        tim = f"count(TRY_CAST({c} AS TIMESTAMP)) / count(*)" if text else "NULL"
        u = f"count(DISTINCT {c})"
        cat = f"{u} / count(*) < 0.3 AND {u} < 50" if text else f"{u} < 20"
        parts.append(f"""SELECT '{c}' AS column_name, '{kind}' AS type, count(*) AS n_rows, {u} AS n_unique,
 count(*) - count({c}) AS n_missing, {rnd(num)} AS numeric_rate, {rnd(tim)} AS datetime_rate,
 {f'{num} > 0.5' if text else 'false'} AS to_numeric, {f'{tim} > 0.5' if text else 'false'} AS to_datetime,
 {cat} AS to_category FROM fx_dirty""")
    return "\nUNION ALL\n".join(parts)


@query("type_conversion_options", options_sql())
def type_conversion_options(t):
    return rounded(C.conversion_options(t.dirty))


@query("convert_type", """SELECT o_orderkey, TRY_CAST(price_text AS DOUBLE) AS price_text,
 TRY_CAST(order_date_text AS TIMESTAMP) AS order_date_text, o_orderstatus FROM fx_dirty""")
def convert_type(t):
    return rounded(C.convert_type(C.convert_type(t.dirty, "price_text", "numeric"), "order_date_text", "datetime"))


@query("convert_type_category", """SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name_code FROM part""")
def convert_type_category(t):
    return C.convert_type(t.part.select("p_partkey", "p_name"), "p_name", "category")


def narrow_sql() -> str:
    parts = []
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMERIC]:
        kind = LINE_TYPES[c]
        if kind == "double":
            to = f"CASE WHEN bool_and(CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}) THEN 'float' ELSE 'double' END"
        else:
            wide = f" WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int'" if kind == "bigint" else ""
            to = (f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' "
                  f"WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'{wide} ELSE '{kind}' END")
        parts.append(f"SELECT '{c}' AS column_name, '{kind}' AS from_type, {to} AS to_type, count({c}) AS n FROM lineitem")
    size = "CASE {} WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4 WHEN 'float' THEN 4 ELSE 8 END"
    return (f"SELECT *, CAST(n * ({size.format('from_type')} - {size.format('to_type')}) AS BIGINT) AS saved_bytes FROM ("
            + "\nUNION ALL\n".join(parts) + ")")


@query("narrow_types", narrow_sql())
def narrow_types(t):
    return C.narrowing_plan(t.lineitem)


@query("dictionary_candidates", union_all(["c_name", "c_mktsegment"], lambda c: f"""SELECT '{c}' AS column_name,
 count(DISTINCT {c}) AS n_unique, count(*) AS n_rows, {rnd(f'count(DISTINCT {c}) / count(*)')} AS unique_ratio,
 count(DISTINCT {c}) / count(*) < 0.5 AS use_dictionary FROM customer"""))
def dictionary_candidates(t):
    return rounded(C.dictionary_candidates(t.customer))


@query("complete_cases", "SELECT l_orderkey, l_linenumber, l_partkey, discount_m, flag_m FROM fx_missing "
       "WHERE discount_m IS NOT NULL AND flag_m IS NOT NULL")
def complete_cases(t):
    return rounded(C.complete_cases(t.missing, ["discount_m", "flag_m"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "discount_m", "flag_m"))


@query("group_split", f"""SELECT l_returnflag, count(l_extendedprice) AS n, {rnd('avg(l_extendedprice)')} AS mean,
 {rnd('stddev_samp(l_extendedprice)')} AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max
 FROM lineitem GROUP BY l_returnflag""")
def group_split(t):
    return rounded(G.split_summary(t.lineitem, "l_returnflag", "l_extendedprice"))
