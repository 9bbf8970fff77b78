"""Duplicate, missing-value and outlier queries."""

from __future__ import annotations

from tabsonde.operators import duplicates as D
from tabsonde.operators import joins as J
from tabsonde.operators import missing as M
from tabsonde.operators import outliers as O
from workload.common import LINE_ORDER, LINE_ORDER_SQL, query, rnd, rounded, union_all

CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query("detect_duplicates", f"SELECT {CUSTOMER}, count(*) - 1 AS extra_copies FROM fx_dupes GROUP BY ALL HAVING count(*) > 1")
def detect_duplicates(t):
    return D.duplicate_groups(t.dupes)


@query("duplicate_count", f"""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) - count(*) AS n_duplicates
 FROM (SELECT count(*) AS n FROM fx_dupes GROUP BY {CUSTOMER})""")
def duplicate_count(t):
    return D.duplicate_count(t.dupes)


@query("drop_duplicates", "SELECT DISTINCT * FROM fx_dupes")
def drop_duplicates(t):
    return D.drop_duplicates(t.dupes)


@query("drop_duplicates_keep_last", """SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, max(l_orderkey * 100 + l_linenumber) AS position
 FROM lineitem GROUP BY ALL""")
def drop_duplicates_keep_last(t):
    df = t.lineitem.selectExpr("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax",
                               "l_orderkey * 100 + l_linenumber AS position")
    return D.drop_duplicates(df, "position", "last")


@query("missing_profile", union_all(["discount_m", "tax_mar", "quantity_mcar", "tax_mostly", "flag_m"], lambda c: (
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, "
    f"{rnd(f'(count(*) - count({c})) / count(*) * 100')} AS percent FROM fx_missing")))
def missing_profile(t):
    return rounded(M.missing_profile(t.missing))


def pattern_sql() -> str:
    cols = ["discount_m", "tax_mar", "quantity_mcar", "tax_mostly", "flag_m"]
    numeric = cols[:-1]
    parts = []
    for c in cols:
        rs = []
        for o in numeric:
            if o != c:
                x, y = f"CAST({c} IS NULL AS INT)", f"CAST({o} IS NOT NULL AS INT)"
                rs.append(f"CASE WHEN count({o}) > 10 THEN abs(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)) END")
        parts.append(f"SELECT '{c}' AS column_name, (count(*) - count({c})) / count(*) AS ratio, "
                     f"greatest({', '.join(rs)}) AS m FROM fx_missing")
    return f"""SELECT column_name, {rnd('ratio')} AS ratio, {rnd('m')} AS max_corr,
 CASE WHEN ratio > 0.9 THEN 'mostly_missing' WHEN m IS NULL THEN 'unavailable' WHEN m < 0.1 THEN 'MCAR'
 WHEN m > 0.3 THEN 'MAR' ELSE 'MNAR' END AS pattern FROM ({" UNION ALL ".join(parts)})"""


@query("missing_pattern", pattern_sql())
def missing_pattern(t):
    return rounded(M.missing_pattern(t.missing))


@query("missing_drop", f"SELECT {LINE_ORDER_SQL}, quantity_mcar FROM fx_missing WHERE quantity_mcar IS NOT NULL")
def missing_drop(t):
    return rounded(M.fill_missing(t.missing, "drop", ["quantity_mcar"]).select(*LINE_ORDER, "quantity_mcar"))


def carried(fn: str, frame: str, part: str = "") -> str:
    over = f"OVER ({part}ORDER BY {LINE_ORDER_SQL} ROWS BETWEEN {frame})"
    return f"""SELECT {LINE_ORDER_SQL}, {fn}(discount_m IGNORE NULLS) {over} AS discount_m,
 {fn}(flag_m IGNORE NULLS) {over} AS flag_m FROM fx_missing"""


@query("missing_ffill", carried("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def missing_ffill(t):
    df = t.missing.select(*LINE_ORDER, "discount_m", "flag_m")
    return rounded(M.fill_missing(df, "forward_fill", ["discount_m", "flag_m"], LINE_ORDER))


@query("missing_bfill", carried("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def missing_bfill(t):
    df = t.missing.select(*LINE_ORDER, "discount_m", "flag_m")
    return rounded(M.fill_missing(df, "backward_fill", ["discount_m", "flag_m"], LINE_ORDER))


@query("missing_ffill_by_key", carried("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY l_linenumber "))
def missing_ffill_by_key(t):
    df = t.missing.select(*LINE_ORDER, "discount_m", "flag_m")
    return rounded(M.fill_carried(df, ["discount_m", "flag_m"],
                                  [c for c in LINE_ORDER if c != "l_linenumber"], ["l_linenumber"]))


def filled(expr: str) -> str:
    return f"SELECT {LINE_ORDER_SQL}, {rnd(expr)} AS discount_m FROM fx_missing"


@query("missing_mean", filled("coalesce(discount_m, (SELECT avg(discount_m) FROM fx_missing))"))
def missing_mean(t):
    return rounded(M.fill_missing(t.missing.select(*LINE_ORDER, "discount_m"), "mean", ["discount_m"]))


@query("missing_median", filled("coalesce(discount_m, (SELECT quantile_cont(discount_m, 0.5) FROM fx_missing))"))
def missing_median(t):
    return rounded(M.fill_missing(t.missing.select(*LINE_ORDER, "discount_m"), "median", ["discount_m"]))


@query("missing_mode", f"""WITH m AS (SELECT flag_m AS v FROM fx_missing WHERE flag_m IS NOT NULL GROUP BY flag_m ORDER BY count(*) DESC, flag_m LIMIT 1)
 SELECT {LINE_ORDER_SQL}, coalesce(flag_m, (SELECT v FROM m)) AS flag_m FROM fx_missing""")
def missing_mode(t):
    return rounded(M.fill_missing(t.missing.select(*LINE_ORDER, "flag_m"), "mode", ["flag_m"]))


@query("missing_interpolate", f"""WITH p AS (SELECT {LINE_ORDER_SQL}, quantity_mcar AS v, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS pos FROM fx_missing),
 q AS (SELECT *, CASE WHEN v IS NOT NULL THEN pos END AS kp FROM p),
 w AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(kp IGNORE NULLS) OVER a AS p0,
   first_value(v IGNORE NULLS) OVER b AS v1, first_value(kp IGNORE NULLS) OVER b AS p1 FROM q
   WINDOW a AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          b AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT {LINE_ORDER_SQL}, {rnd('CASE WHEN v IS NOT NULL THEN v WHEN p0 IS NULL THEN NULL WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END')} AS quantity_mcar FROM w""")
def missing_interpolate(t):
    return rounded(M.fill_missing(t.missing.select(*LINE_ORDER, "quantity_mcar"), "interpolate",
                                  ["quantity_mcar"], LINE_ORDER))


OUT_COLS = ["price_o", "quantity_zero"]
IQR = """b AS (SELECT 'price_o' AS column_name, quantile_cont(price_o, 0.25) AS q1, quantile_cont(price_o, 0.75) AS q3 FROM fx_outliers
 UNION ALL SELECT 'quantity_zero', quantile_cont(CAST(quantity_zero AS DOUBLE), 0.25), quantile_cont(CAST(quantity_zero AS DOUBLE), 0.75) FROM fx_outliers),
 iqr AS (SELECT column_name, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b WHERE q3 <> q1),
 zs AS (SELECT 'price_o' AS column_name, avg(price_o) - 3 * stddev_samp(price_o) AS lower, avg(price_o) + 3 * stddev_samp(price_o) AS upper FROM fx_outliers
 UNION ALL SELECT 'quantity_zero', avg(quantity_zero) - 3 * stddev_samp(quantity_zero), avg(quantity_zero) + 3 * stddev_samp(quantity_zero) FROM fx_outliers),
 cells AS (SELECT {k}, 'price_o' AS column_name, price_o AS value FROM fx_outliers UNION ALL SELECT {k}, 'quantity_zero', quantity_zero FROM fx_outliers)""".replace("{k}", LINE_ORDER_SQL)


def flagged(bounds: str) -> str:
    return f"""WITH {IQR} SELECT {LINE_ORDER_SQL}, column_name, {rnd('value')} AS value, {rnd('lower', 2)} AS lower, {rnd('upper', 2)} AS upper
 FROM cells JOIN {bounds} USING (column_name) WHERE value < lower OR value > upper"""


@query("outliers_iqr", flagged("iqr"))
def outliers_iqr(t):
    return rounded(O.outlier_rows(t.outliers, LINE_ORDER, OUT_COLS, "iqr"), lower=2, upper=2)


@query("outliers_zscore", flagged("zs"))
def outliers_zscore(t):
    return rounded(O.outlier_rows(t.outliers, LINE_ORDER, OUT_COLS, "zscore"), lower=2, upper=2)


@query("outlier_remove", f"""WITH {IQR}, bad AS (SELECT DISTINCT {LINE_ORDER_SQL} FROM cells JOIN zs USING (column_name) WHERE value < lower OR value > upper)
 SELECT {LINE_ORDER_SQL}, {rnd("price_o")} AS price_o FROM fx_outliers o ANTI JOIN bad USING ({LINE_ORDER_SQL})""")
def outlier_remove(t):
    return rounded(O.remove_outliers(t.outliers, OUT_COLS, "zscore").select(*LINE_ORDER, "price_o"))


@query("outlier_cap", f"""WITH q AS (SELECT quantile_cont(price_o, 0.05) AS lo, quantile_cont(price_o, 0.95) AS hi FROM fx_outliers)
 SELECT {LINE_ORDER_SQL}, {rnd('greatest(least(price_o, hi), lo)')} AS price_o FROM fx_outliers, q""")
def outlier_cap(t):
    return rounded(O.cap_outliers(t.outliers.select(*LINE_ORDER, "price_o"), ["price_o"]))


def replaced(stat: str) -> str:
    return f"""WITH {IQR}, s AS (SELECT {stat} AS v FROM fx_outliers)
 SELECT {LINE_ORDER_SQL}, {rnd('CASE WHEN price_o < lower OR price_o > upper THEN v ELSE price_o END')} AS price_o
 FROM fx_outliers, s, iqr WHERE iqr.column_name = 'price_o'"""


@query("outlier_mean", replaced("avg(price_o)"))
def outlier_mean(t):
    return rounded(O.replace_outliers(t.outliers.select(*LINE_ORDER, "price_o"), ["price_o"], "mean"))


@query("outlier_median", replaced("quantile_cont(price_o, 0.5)"))
def outlier_median(t):
    return rounded(O.replace_outliers(t.outliers.select(*LINE_ORDER, "price_o"), ["price_o"], "median"))


@query("preprocess_summary", """SELECT count(*) AS rows_before, CAST(sum(CAST(discount_m IS NULL AS INT) + CAST(flag_m IS NULL AS INT)) AS BIGINT) AS missing_before,
 CAST(3 AS BIGINT) AS columns_before, count(*) FILTER (discount_m IS NOT NULL) AS rows_after,
 count(*) FILTER (discount_m IS NOT NULL AND flag_m IS NULL) AS missing_after, CAST(3 AS BIGINT) AS columns_after,
 count(*) - count(discount_m) AS rows_removed FROM fx_missing""")
def preprocess_summary(t):
    before = t.missing.select("l_orderkey", "discount_m", "flag_m")
    return O.preprocessing_summary(before, M.drop_missing(before, ["discount_m"]))


@query("align_rows", "SELECT l_orderkey, l_linenumber, l_partkey, discount_m, quantity_mcar FROM fx_missing "
       "WHERE discount_m IS NOT NULL AND quantity_mcar IS NOT NULL")
def align_rows(t):
    return rounded(J.align_columns(t.missing.select("l_orderkey", "l_linenumber", "l_partkey", "discount_m", "quantity_mcar"),
                                   ["discount_m", "quantity_mcar"]))


@query("align_frames", "SELECT o_orderkey, o_totalprice, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def align_frames(t):
    return rounded(J.align_frames(t.orders.select("o_orderkey", "o_totalprice"),
                                  t.lineitem.selectExpr("l_orderkey AS o_orderkey", "l_extendedprice"), ["o_orderkey"]))


@query("semi_join_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def semi_join_rows(t):
    return rounded(J.keep_matching(t.orders.select("o_orderkey", "o_totalprice"),
                                   t.lineitem.where("l_discount > 0.09").selectExpr("l_orderkey AS o_orderkey"), ["o_orderkey"]))


@query("anti_join_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def anti_join_rows(t):
    return rounded(J.drop_matching(t.orders.select("o_orderkey", "o_totalprice"),
                                   t.lineitem.where("l_discount > 0.09").selectExpr("l_orderkey AS o_orderkey"), ["o_orderkey"]))


@query("stat_broadcast", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag,
 {rnd('avg(l_extendedprice) OVER (PARTITION BY l_returnflag)')} AS group_mean,
 {rnd('(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)) / stddev_samp(l_extendedprice) OVER (PARTITION BY l_returnflag)')} AS z FROM lineitem""")
def stat_broadcast(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")
    return rounded(J.attach_group_stats(df, ["l_returnflag"], "l_extendedprice"))


@query("union_frames", "SELECT c_custkey AS key, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_frames(t):
    return D.union_frames([t.customer.selectExpr("c_custkey AS key", "c_acctbal AS acctbal"),
                           t.supplier.selectExpr("s_acctbal AS acctbal", "s_suppkey AS key")])
