"""Insight, report and user-function queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsonde.operators import columns as C
from tabsonde.operators import insights as I
from tabsonde.operators import report as R
from tabsonde.operators import userfuncs as U
from workload.learning import predictive_sql
from workload.common import LINE_ORDER, LINE_ORDER_SQL, query, rnd, rounded

SEGMENT_FREQ = "f AS (SELECT 'segment' AS column_name, segment AS value, count(*) AS n FROM fx_segments GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*) FROM fx_segments GROUP BY ALL), " \
               "s AS (SELECT *, n / sum(n) OVER (PARTITION BY column_name) AS ratio, count(*) OVER (PARTITION BY column_name) AS k FROM f)"


@query("category_imbalance", f"WITH {SEGMENT_FREQ} SELECT column_name, value, n, {rnd('ratio')} AS ratio FROM s WHERE ratio > 0.7 AND k > 1")
def category_imbalance(t):
    return rounded(I.category_imbalance(t.segments))


@query("rare_categories", """WITH f AS (SELECT c_name AS value, count(*) AS n FROM customer GROUP BY ALL),
 s AS (SELECT *, n / sum(n) OVER () AS ratio FROM f), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM s WHERE ratio < 0.01)
 SELECT 'c_name' AS column_name, count(*) AS rare_count, string_agg(value, ', ' ORDER BY k) FILTER (k <= 5) AS examples FROM r HAVING count(*) > 0""")
def rare_categories(t):
    return I.rare_categories(t.customer, ["c_name", "c_mktsegment"])


@query("insight_category", f"""WITH {SEGMENT_FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS q FROM s WHERE ratio < 0.01)
 SELECT 'imbalance' AS type, column_name AS columns, 'dominant_ratio' AS metric, {rnd('ratio')} AS value, 'warning' AS level,
 '''' || value || ''' makes up most of ' || column_name AS message FROM s WHERE ratio > 0.7 AND k > 1
 UNION ALL SELECT 'rare_categories', column_name, 'rare_count', count(*)::DOUBLE, 'info', column_name || ' has rare values such as ' || string_agg(value, ', ' ORDER BY q) FILTER (q <= 5) FROM r GROUP BY column_name""")
def insight_category(t):
    return rounded(I.category_insights(t.segments))


RELATED = "SELECT l_quantity, l_quantity * 2 + l_tax * 10 AS doubled, 100 - l_quantity + l_linenumber * 4 AS mirrored, l_discount FROM lineitem"
REL_COLS = ["l_quantity", "doubled", "mirrored", "l_discount"]


def related(t):
    return t.lineitem.selectExpr("l_quantity", "l_quantity * 2 + l_tax * 10 AS doubled",
                                 "100 - l_quantity + l_linenumber * 4 AS mirrored", "l_discount")


PAIR_ROWS = "\nUNION ALL\n".join(f"SELECT {i} AS o, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rel"
                                 for i, (a, b) in enumerate((a, b) for j, a in enumerate(REL_COLS) for b in REL_COLS[j + 1:]))


@query("insight_correlation", f"""WITH rel AS ({RELATED}), p AS ({PAIR_ROWS})
 SELECT 'correlation' AS type, a || ', ' || b AS columns, 'r' AS metric, {rnd('r')} AS value, CASE WHEN abs(r) >= 0.8 THEN 'high' ELSE 'moderate' END AS level,
 a || ' and ' || b || ' move ' || CASE WHEN r > 0 THEN 'together' ELSE 'in opposite directions' END || ' (r = ' || CAST(round(r, 2) AS VARCHAR) || ')' AS message FROM p WHERE abs(r) >= 0.7""")
def insight_correlation(t):
    return rounded(I.correlation_insights(related(t)))


@query("insight_quality", """WITH q AS (SELECT l_quantity, l_quantity * 2 + l_tax * 10 AS doubled,
   CASE WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price_o, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END AS gaps FROM lineitem)
 SELECT 'high_missing' AS type, 'gaps' AS columns, 'percent' AS metric, """ + rnd("(count(*) - count(gaps)) * 100 / count(*)") + """ AS value, 'warning' AS level, 'gaps: consider filling or dropping it' AS message
   FROM q HAVING (count(*) - count(gaps)) * 100 / count(*) > 20
 UNION ALL SELECT 'high_correlation', '', 'pairs', 1.0, 'info', '1 pairs are nearly collinear' FROM q HAVING abs(corr(l_quantity, doubled)) > 0.8
 UNION ALL SELECT 'skewed', 'price_o', 'skewness', """ + rnd("skewness(price_o)") + """, 'info', 'price_o: consider a log or root transform' FROM q HAVING abs(skewness(price_o)) > 2""")
def insight_quality(t):
    df = t.lineitem.selectExpr("l_quantity", "l_quantity * 2 + l_tax * 10 AS doubled",
                               "CASE WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price_o",
                               "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END AS gaps")
    return rounded(I.quality_insights(df))


@query("insight_trend", f"""WITH s AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) AS value FROM orders GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos FROM s), r AS (SELECT count(*) AS n, regr_slope(value, pos) AS slope, regr_r2(value, pos) AS r2 FROM p),
 v AS (SELECT stddev_samp((value - l) / l) AS v FROM (SELECT value, lag(value) OVER (ORDER BY ts) AS l FROM s)),
 g AS (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) > 1.961 AS real FROM r, v)
 SELECT 'trend' AS type, 'o_orderdate, o_totalprice' AS columns, 'slope' AS metric, {rnd('slope')} AS value,
 CASE WHEN NOT real THEN 'weak' WHEN sqrt(r2) > 0.7 THEN 'strong' ELSE 'moderate' END AS level FROM g""")
def insight_trend(t):
    return rounded(I.trend_insights(t.orders, "o_orderdate", "o_totalprice").drop("message"))


@query("insight_anomaly")
def insight_anomaly(t):
    return rounded(I.anomaly_insights(t.outliers, ["price_o", "quantity_zero"]))


@query("insight_predictive", f"""WITH {predictive_sql('part', ['p_size', 'p_partkey'], 'p_retailprice', ['p_partkey'])},
 q AS (SELECT any_value(r2) AS r2, string_agg(feature, ', ' ORDER BY rank) AS feature FROM fit WHERE rank <= 3),
 l AS (SELECT *, CASE WHEN r2 > 0.7 THEN 'high' WHEN r2 > 0.5 THEN 'adequate' ELSE 'limited' END AS level FROM q)
 SELECT 'predictive' AS type, 'p_retailprice' AS columns, 'r2' AS metric, {rnd('r2')} AS value, level,
  'p_retailprice is predicted with ' || level || ' accuracy; strongest predictors: ' || feature AS message FROM l""")
def insight_predictive(t):
    return rounded(I.predictive_insights(t.part, ["p_size", "p_partkey"], "p_retailprice", ["p_partkey"]))


REP = "rep AS (SELECT l_quantity, discount_m, tax_mostly, flag_m FROM fx_missing)"
REP_NUM, REP_ALL = ["l_quantity", "discount_m", "tax_mostly"], ["l_quantity", "discount_m", "tax_mostly", "flag_m"]


def rep(t):
    return t.missing.select(*REP_ALL)


def row_sql(section, metric, value="NULL", text="NULL", column="NULL", item="NULL", tail=" FROM rep") -> str:
    return (f"SELECT '{section}' AS section, {metric} AS metric, {column}::VARCHAR AS column_name, {item}::VARCHAR AS item, "
            f"{rnd(value)} AS value, {text}::VARCHAR AS text{tail}")


def described_sql(section: str) -> list[str]:
    fn = {"n": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "q25": "quantile_cont(CAST({c} AS DOUBLE), 0.25)",
          "median": "quantile_cont(CAST({c} AS DOUBLE), 0.5)", "q75": "quantile_cont(CAST({c} AS DOUBLE), 0.75)", "max": "max({c})"}
    return [row_sql(section, f"'{s}'", e.format(c=c), column=f"'{c}'") for c in REP_NUM for s, e in fn.items()]


def missing_sql(section: str, metrics: dict[str, str]) -> list[str]:
    return [row_sql(section, f"'{m}'", e.format(c=c), column=f"'{c}'") for c in REP_ALL[1:] for m, e in metrics.items()]


def corr_sql(section: str) -> list[str]:
    return [row_sql(section, "'r'", f"corr({a}, {b})", column=f"'{a}'", item=f"'{b}'")
            for i, a in enumerate(REP_NUM) for b in REP_NUM[i + 1:]]


ALL_GONE = " + ".join(f"count(*) - count({c})" for c in REP_ALL)
SUMMARY = [
    row_sql("basic_info", "'n_rows'", "count(*)"), row_sql("basic_info", "'n_columns'", "4 + 0 * count(*)"),
    row_sql("basic_info", "'missing_cells'", ALL_GONE), row_sql("basic_info", "'missing_percent'", f"({ALL_GONE}) * 100 / (count(*) * 4)"),
    row_sql("basic_info", "'numeric_columns'", "3 + 0 * count(*)"), row_sql("basic_info", "'categorical_columns'", "1 + 0 * count(*)"),
    row_sql("basic_info", "'datetime_columns'", "0 * count(*)"),
    row_sql("basic_info", "'bytes'", " + ".join(f"8 * count({c})" for c in REP_NUM) + " + sum(strlen(flag_m))"),
    row_sql("basic_info", "'type'", "3 + 0 * count(*)", item="'double'"), row_sql("basic_info", "'type'", "1 + 0 * count(*)", item="'string'"),
    *missing_sql("missing", {"n_missing": "count(*) - count({c})", "percent": "(count(*) - count({c})) * 100 / count(*)"}),
    *described_sql("numeric"),
    row_sql("categorical", "'n_unique'", "count(DISTINCT flag_m)", column="'flag_m'"),
    row_sql("categorical", "'mode'", "n", "flag_m", "'flag_m'", tail=" FROM fq WHERE k = 1"),
    row_sql("categorical", "'top'", "n", "flag_m", "'flag_m'", "k", tail=" FROM fq WHERE k <= 5")]
FQ = "fq AS (SELECT flag_m, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, flag_m) AS k FROM rep WHERE flag_m IS NOT NULL GROUP BY flag_m)"


@query("report_summary", f"WITH {REP}, {FQ} " + "\nUNION ALL\n".join(SUMMARY))
def report_summary(t):
    return rounded(R.summary_section(rep(t)))


STATISTICS = [row_sql("quality", "'duplicate_rows'", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rep))"),
              *missing_sql("quality", {"missing_values": "count(*) - count({c})"}), *described_sql("basic_stats"), *corr_sql("correlations")]


@query("report_statistics", f"WITH {REP} " + "\nUNION ALL\n".join(STATISTICS))
def report_statistics(t):
    return rounded(R.statistics_section(rep(t)))


@query("report_two_sections", f"WITH {REP}, {FQ}, su AS (" + "\nUNION ALL\n".join(SUMMARY) + "), st AS (" + "\nUNION ALL\n".join(STATISTICS)
       + ") SELECT 'summary' AS part, * FROM su UNION ALL SELECT 'statistics', * FROM st")
def report_two_sections(t):
    return rounded(R.report_tables(rep(t), R.ReportConfig(include_visualizations=False, include_insights=False)))


@query("report_charts")
def report_charts(t):
    return rounded(R.chart_section(rep(t)))


@query("sink_report_tables")
def sink_report_tables(t):
    return rounded(R.report_tables(rep(t)))


@query("quality_check", """WITH d AS (SELECT price_text, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS maybe FROM fx_dirty),
 a AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE maybe % 50 = 1)
 SELECT 'missing_values' AS issue, 'maybe' AS column_name, count(*) - count(maybe) AS n FROM a
 UNION ALL SELECT 'duplicate_rows', NULL, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) FROM a
 UNION ALL SELECT 'numeric_text', 'price_text', count(TRY_CAST(price_text AS DOUBLE)) FROM a""")
def quality_check(t):
    d = t.dirty.selectExpr("price_text", "o_orderstatus", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS maybe")
    return R.quality_check(d.unionByName(d.where("maybe % 50 = 1")))


@query("sort_rows", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def sort_rows(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority")


def with_net(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(net=(pdf["l_extendedprice"] * (1 - pdf["l_discount"])).round(4))


NET_SCHEMA = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_extendedprice double, l_discount double, net double"
NET_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"]


@query("apply_chunks", f"SELECT l_returnflag, count(*) AS n, {rnd('sum(l_extendedprice * (1 - l_discount)) / 1000', 2)} AS net FROM lineitem GROUP BY ALL")
def apply_chunks(t):
    df = U.apply_chunks(t.lineitem.select("l_returnflag", "l_extendedprice", "l_discount"), with_net,
                        "l_returnflag string, l_extendedprice double, l_discount double, net double")
    return rounded(df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), (F.sum("net") / 1000).alias("net")), 2)


@query("apply_parallel", f"SELECT count(*) AS n, {rnd('sum(l_extendedprice * (1 - l_discount)) / 1000', 2)} AS net FROM lineitem")
def apply_parallel(t):
    df = U.apply_parallel(t.lineitem.select(*NET_COLS), with_net, NET_SCHEMA, 16)
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), (F.sum("net") / 1000).alias("net")), 2)


def partial_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.groupby("l_returnflag", as_index=False).agg(
        quantity=("l_quantity", "sum"), rows=("l_quantity", "size"), best=("l_extendedprice", "max"))


@query("apply_grouped", "SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS rows, max(l_extendedprice) AS best FROM lineitem GROUP BY ALL")
def apply_grouped(t):
    return U.apply_grouped(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], partial_totals,
                           "l_returnflag string, quantity double, rows bigint, best double",
                           {"quantity": "sum", "rows": "sum", "best": "max"})


def deepest_fall(key, batches):
    """The largest fall of the price below what it has been, and the rows seen, in one run over a group."""
    top, fall, n = float("-inf"), 0.0, 0
    for pdf in batches:
        highest = np.maximum(np.maximum.accumulate(pdf.l_extendedprice.to_numpy()), top)
        top, fall, n = highest[-1], max(fall, (highest - pdf.l_extendedprice).max()), n + len(pdf)
    yield pd.DataFrame({"l_returnflag": [key[0]], "n": [n], "fall": [fall]})


@query("apply_group_batches", f"""WITH f AS (SELECT l_returnflag, max(l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY {LINE_ORDER_SQL} ROWS UNBOUNDED PRECEDING)
  - l_extendedprice AS fall FROM lineitem) SELECT l_returnflag, count(*) AS n, {rnd('max(fall)')} AS fall FROM f GROUP BY l_returnflag""")
def apply_group_batches(t):
    return rounded(U.apply_group_batches(t.lineitem.select("l_returnflag", *LINE_ORDER), ["l_returnflag"], deepest_fall,
                                         "l_returnflag string, n bigint, fall double", LINE_ORDER))


@query("optimise_table", "SELECT DISTINCT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM fx_dupes")
def optimise_table(t):
    return rounded(C.optimise_table(t.dupes, ["c_custkey"]))
