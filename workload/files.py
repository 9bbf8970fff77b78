"""Sources and sinks: tables written to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsonde.operators import report as R
from tabsonde.plans.storage import Scratch
from tabsonde.sources import readers, sinks
from workload.common import query, rnd, rounded
from workload.findings import FQ, REP, STATISTICS, SUMMARY, rep

SUPPLIER = f"SELECT s_suppkey, s_name, s_nationkey, {rnd('s_acctbal', 2)} AS s_acctbal FROM supplier"
SECTIONS = (f"WITH {REP}, {FQ}, su AS (" + "\nUNION ALL\n".join(SUMMARY) + "), st AS (" + "\nUNION ALL\n".join(STATISTICS)
            + ") SELECT 'summary' AS part, * FROM su UNION ALL SELECT 'statistics', * FROM st")
TWO = R.ReportConfig(include_visualizations=False, include_insights=False)


def supplier(t):
    return t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def place(t, name: str) -> str:
    return f"{Scratch(t.spark).base}/{name}"


@query("src_csv", SUPPLIER)
def src_csv(t):
    return rounded(readers.load(sinks.write_csv(supplier(t), place(t, "supplier.csv")), t.spark), 2)


@query("src_csv_chunked", SUPPLIER)
def src_csv_chunked(t):
    return rounded(readers.read_csv_narrow(t.spark, sinks.write_csv(supplier(t), place(t, "supplier.csv"))), 2)


@query("src_csv_encoding_fallback", "SELECT n_nationkey, n_name || ' 서울' AS n_name FROM nation")
def src_csv_encoding_fallback(t):
    path = place(t, "nation.csv")
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark writes CP949 only with it
    (t.nation.select("n_nationkey", F.concat("n_name", F.lit(" 서울")).alias("n_name"))
     .write.option("header", True).option("encoding", readers.FALLBACK_ENCODING).csv(path))
    return rounded(readers.load(path, t.spark))


@query("src_json", SUPPLIER)
def src_json(t):
    path = place(t, "supplier.json")
    supplier(t).write.json(path)
    return rounded(readers.load(path, t.spark), 2).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("src_cached", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def src_cached(t):
    kept = readers.cached(t.orders.select("o_orderstatus", "o_custkey"))
    counts = kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(kept.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers")), "o_orderstatus")
    out = Scratch(t.spark).keep(out, "counts")  # three rows; the cache is not needed any more
    kept.unpersist()
    return out


@query("src_guard", """SELECT 'orders' AS name, count(*) > 0 AS usable FROM orders
 UNION ALL SELECT 'old orders', count(*) > 0 FROM orders WHERE o_orderdate < TIMESTAMP '1900-01-01'""")
def src_guard(t):
    found = []
    for name, df in (("orders", t.orders), ("old orders", t.orders.where("o_orderdate < timestamp_ntz'1900-01-01'"))):
        try:
            readers.require_rows(df)
            found.append((name, True))
        except ValueError:
            found.append((name, False))
    return t.spark.createDataFrame(found, "name string, usable boolean")


@query("sink_csv", f"SELECT o_orderkey, o_orderstatus, {rnd('o_totalprice', 2)} AS o_totalprice FROM orders")
def sink_csv(t):
    path = sinks.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), place(t, "orders"))
    back = t.spark.read.option("header", True).schema("o_orderkey bigint, o_orderstatus string, o_totalprice double").csv(path)
    return rounded(back, 2)


@query("sink_json_report", SECTIONS)
def sink_json_report(t):
    path = sinks.write_json_report(rep(t), place(t, "report"), TWO)
    schema = ", ".join(f"{c} {'double' if c == 'value' else 'string'}" for c in R.SECTION_COLUMNS)
    parts = [t.spark.read.schema(schema).json(f"{path}/{name}").select(F.lit(name).alias("part"), *R.SECTION_COLUMNS)
             for name in ("summary", "statistics")]
    return rounded(parts[0].unionByName(parts[1]))


@query("sink_report", SECTIONS)
def sink_report(t):
    return rounded(t.spark.read.parquet(sinks.write_report(rep(t), place(t, "report"), TWO)).select("part", *R.SECTION_COLUMNS))


@query("sink_cached_result", f"SELECT l_returnflag, count(*) AS n, {rnd('sum(l_quantity)', 2)} AS quantity FROM lineitem GROUP BY ALL")
def sink_cached_result(t):
    build = lambda: t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    base, key = Scratch(t.spark).base, sinks.result_key("totals", t.lineitem)
    sinks.cached_result(base, key, t.spark, build)

    def again():
        raise RuntimeError("built twice")
    return rounded(sinks.cached_result(base, key, t.spark, again), 2)
