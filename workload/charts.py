"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsonde.operators import charts as K
from tabsonde.operators import regression as G
from workload.common import LINE_NUMERIC, LINE_ORDER, LINE_ORDER_SQL, query, rnd, rounded, union_all
from workload.statistics import ppf_sql


def bin_sql(c: str, bins: int = 30) -> str:
    return f"CAST(least(floor(({c} - mn_{c}) / ((mx_{c} - mn_{c}) / {bins}.0::DOUBLE)), {bins - 1}) AS BIGINT)"


def spans(cols, table="lineitem") -> str:
    return "r AS (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols) + f" FROM {table})"


def histogram_sql(cols, table="lineitem", by="", bins=30) -> str:
    keys = f"{by}, " if by else ""
    return f"WITH {spans(cols, table)} " + union_all(cols, lambda c: f"""SELECT {keys}'{c}' AS column_name, {bin_sql(c, bins)} AS bin,
 {rnd(f'any_value(mn_{c}) + {bin_sql(c, bins)} * ((any_value(mx_{c}) - any_value(mn_{c})) / {bins}.0::DOUBLE)')} AS low,
 {rnd(f'any_value(mn_{c}) + ({bin_sql(c, bins)} + 1) * ((any_value(mx_{c}) - any_value(mn_{c})) / {bins}.0::DOUBLE)')} AS high, count(*) AS n
 FROM {table}, r WHERE {c} IS NOT NULL GROUP BY {keys}{bin_sql(c, bins)}""")


@query("histogram", histogram_sql(LINE_NUMERIC))
def histogram(t):
    return rounded(K.histogram(t.lineitem, LINE_NUMERIC))


def box_sql(c: str) -> str:
    ok = f"{c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""SELECT '{c}' AS column_name, {rnd('any_value(q1)')} AS q1, {rnd('any_value(md)')} AS median, {rnd('any_value(q3)')} AS q3,
 {rnd(f'min({c}) FILTER ({ok})')} AS whisker_low, {rnd(f'max({c}) FILTER ({ok})')} AS whisker_high, count(*) FILTER (NOT ({ok})) AS n_outside
 FROM fx_outliers, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS md, quantile_cont({c}, 0.75) AS q3 FROM fx_outliers)"""


@query("histogram_box", union_all(["price_o", "l_extendedprice"], box_sql))
def histogram_box(t):
    return rounded(K.box(t.outliers, ["price_o", "l_extendedprice"]))


@query("histogram_by_group", histogram_sql(["metric"], "fx_two_arm", "arm"))
def histogram_by_group(t):
    return rounded(K.histogram(t.two_arm, ["metric"], by=["arm"]))


@query("box_by_group", f"""SELECT l_returnflag, {rnd('min(l_extendedprice)')} AS min, {rnd('quantile_cont(l_extendedprice, 0.25)')} AS q1,
 {rnd('quantile_cont(l_extendedprice, 0.5)')} AS median, {rnd('quantile_cont(l_extendedprice, 0.75)')} AS q3, {rnd('max(l_extendedprice)')} AS max
 FROM lineitem GROUP BY l_returnflag""")
def box_by_group(t):
    return rounded(K.box_by_group(t.lineitem, "l_returnflag", "l_extendedprice"))


@query("pie_data", union_all(["p_brand", "p_type"], lambda c: f"""SELECT '{c}' AS column_name, {c} AS value, count(*) AS n,
 {rnd('count(*) * 100 / sum(count(*)) OVER ()')} AS percent FROM part GROUP BY {c}"""))
def pie_data(t):
    return rounded(K.category_share(t.part, ["p_brand", "p_type"]))


@query("treemap_data", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def treemap_data(t):
    return K.treemap(t.part, ["p_brand", "p_type"])


XY = ["l_quantity", "l_extendedprice"]


@query("scatter_data", f"""WITH {spans(XY)} SELECT l_returnflag, {bin_sql(XY[0])} AS x_bin, {bin_sql(XY[1])} AS y_bin, count(*) AS n,
 {rnd('avg(l_quantity)', 6)} AS x_mean, {rnd('avg(l_extendedprice)', 6)} AS y_mean FROM lineitem, r GROUP BY ALL""")
def scatter_data(t):
    return rounded(K.scatter_density(t.lineitem, *XY, by=["l_returnflag"]), 6)


@query("scatter_line", f"""SELECT count(*) AS n, {rnd('regr_slope(l_extendedprice, l_quantity)')} AS slope, {rnd('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
 min(l_quantity) AS x_1, {rnd('regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * min(l_quantity)')} AS y_1,
 max(l_quantity) AS x_2, {rnd('regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * max(l_quantity)')} AS y_2 FROM lineitem""")
def scatter_line(t):
    return rounded(K.scatter_line(t.lineitem, *XY))


GRID = ["l_quantity", "l_extendedprice", "l_discount"]


@query("scatter_sample_3d", f"SELECT {', '.join(LINE_ORDER)}, l_quantity, l_discount, l_returnflag FROM lineitem")
def scatter_sample_3d(t):
    return K.scatter_sample(t.lineitem, GRID, LINE_ORDER, None, ["l_returnflag"])


@query("scatter_density_3d", f"""WITH {spans(GRID)} SELECT l_returnflag, {bin_sql(GRID[0])} AS x_bin, {bin_sql(GRID[1])} AS y_bin,
 {bin_sql(GRID[2])} AS z_bin, count(*) AS n, {rnd('avg(l_quantity)', 6)} AS x_mean, {rnd('sum(l_extendedprice)', 2)} AS y_sum,
 {rnd('avg(l_discount)', 6)} AS z_mean FROM lineitem, r GROUP BY ALL""")
def scatter_density_3d(t):
    out = K.scatter_density_3d(t.lineitem, GRID, by=["l_returnflag"])
    return rounded(out.withColumn("y_sum", F.col("y_mean") * F.col("n")).drop("y_mean"), 6, y_sum=2)


@query("pair_grid", f"WITH {spans(GRID)} " + "\nUNION ALL\n".join(
    f"SELECT l_linestatus, '{a}' AS x_column, '{b}' AS y_column, {bin_sql(a, 20)} AS x_bin, {bin_sql(b, 20)} AS y_bin, count(*) AS n FROM lineitem, r GROUP BY ALL"
    for i, a in enumerate(GRID) for b in GRID[i + 1:]))
def pair_grid(t):
    return K.pair_grid(t.lineitem, GRID, by=["l_linestatus"])


def density_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, x, sum(n * exp(-power((x - mid) / h, 2) / 2) / (m * h * sqrt(2 * pi()))) AS d
 FROM (SELECT mn_{c} + ({bin_sql(c, 100)} + 0.5) * ((mx_{c} - mn_{c}) / 100) AS mid, count(*) AS n FROM lineitem, r GROUP BY ALL),
 (SELECT count(*) AS m, stddev_samp({c}) * power(count(*), -0.2) AS h FROM lineitem),
 (SELECT mn_{c} + i * ((mx_{c} - mn_{c}) / 49) AS x FROM r, range(50) g(i)) GROUP BY x"""


@query("pair_grid_density", f"WITH {spans(GRID)} SELECT column_name, {rnd('x')} AS x, {rnd('d', 8)} AS density FROM ("
       + union_all(GRID, density_sql) + ")")
def pair_grid_density(t):
    return rounded(K.density(t.lineitem, GRID), 4, density=8)


@query("qq_points", f"""WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders),
 p AS (SELECT *, (i - 0.5::DOUBLE) / n AS p FROM o) SELECT i, {rnd(ppf_sql('p'), 6)} AS theoretical, v AS sample FROM p""")
def qq_points(t):
    return rounded(K.qq_points(t.orders, "o_totalprice"), 6)


@query("qq_points_thinned", f"""WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders),
 k AS (SELECT DISTINCT CAST(ceil((j - 0.5::DOUBLE) * (SELECT count(*) FROM orders) / 1000) AS BIGINT) AS i FROM range(1, 1001) g(j)),
 p AS (SELECT i, v, (i - 0.5::DOUBLE) / n AS p FROM o JOIN k USING (i))
 SELECT i, {rnd(ppf_sql('p'), 6)} AS theoretical, v AS sample FROM p""")
def qq_points_thinned(t):
    return rounded(K.qq_points(t.orders, "o_totalprice", 1000), 6)


@query("qq_points_all_ranks", f"""WITH o AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS i, count(*) OVER () AS n FROM lineitem),
 p AS (SELECT *, (i - 0.5::DOUBLE) / n AS p FROM o) SELECT i, {rnd(ppf_sql('p'), 6)} AS theoretical, v AS sample FROM p""")
def qq_points_all_ranks(t):
    return rounded(K.qq_points(t.lineitem, "l_quantity", None), 6)


FIT = """f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
 pr AS (SELECT *, a + b * l_quantity AS fitted, l_extendedprice - (a + b * l_quantity) AS residual FROM lineitem, f)"""


@query("residual_data", f"""WITH {FIT} SELECT {LINE_ORDER_SQL}, l_extendedprice AS actual, {rnd('fitted', 3)} AS fitted, {rnd('residual', 3)} AS residual FROM pr""")
def residual_data(t):
    return rounded(K.residuals(t.lineitem, ["l_quantity"], "l_extendedprice", LINE_ORDER), 3)


@query("residual_histogram", f"""WITH {FIT}, r AS (SELECT min(residual) AS mn_residual, max(residual) AS mx_residual FROM pr)
 SELECT 'residual' AS column_name, {bin_sql('residual')} AS bin, {rnd('mn_residual + ' + bin_sql('residual') + ' * ((mx_residual - mn_residual) / 30.0::DOUBLE)', 3)} AS low,
 {rnd('mn_residual + (' + bin_sql('residual') + ' + 1) * ((mx_residual - mn_residual) / 30.0::DOUBLE)', 3)} AS high, count(*) AS n FROM pr, r GROUP BY ALL""")
def residual_histogram(t):
    return rounded(K.residual_histogram(t.lineitem, ["l_quantity"], "l_extendedprice"), 3)


@query("pred_vs_actual", f"""WITH {FIT}, v AS (SELECT l_extendedprice AS actual, fitted FROM pr), r AS (SELECT min(actual) AS mn_actual, max(actual) AS mx_actual, min(fitted) AS mn_fitted, max(fitted) AS mx_fitted FROM v)
 SELECT {bin_sql('actual')} AS x_bin, {bin_sql('fitted')} AS y_bin, count(*) AS n, {rnd('sum(actual)', 2)} AS x_sum, {rnd('avg(fitted)', 6)} AS y_mean FROM v, r GROUP BY ALL""")
def pred_vs_actual(t):
    cells = K.predicted_against_actual(t.lineitem, ["l_quantity"], "l_extendedprice")
    # Means of prices with two decimals can end in an exact 5; their sums cannot.
    return rounded(cells.withColumn("x_sum", cells.x_mean * cells.n).drop("x_mean"), 6, x_sum=2)


@query("parallel_coords", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag,
 dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus, l_extendedprice FROM lineitem""")
def parallel_coords(t):
    return rounded(K.parallel_lines(t.lineitem, ["l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice"],
                                    ["l_orderkey", "l_linenumber", "l_partkey"]))


@query("parallel_axes", """SELECT 'l_quantity' AS column_name, 'range' AS kind, min(l_quantity) AS low, max(l_quantity) AS high, NULL::VARCHAR AS label FROM lineitem
 UNION ALL SELECT DISTINCT 'l_returnflag', 'label', (dense_rank() OVER (ORDER BY l_returnflag) - 1)::DOUBLE, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::DOUBLE, l_returnflag FROM lineitem""")
def parallel_axes(t):
    return rounded(K.parallel_axes(t.lineitem, ["l_quantity", "l_returnflag"]))


MATRIX = ["l_quantity", "discount_m", "tax_mar", "quantity_mcar", "tax_mostly", "flag_m"]


@query("missing_matrix", "SELECT " + ", ".join(f"CAST({c} IS NULL AS BIGINT) AS {c}" for c in MATRIX) + ", count(*) AS n_rows FROM fx_missing GROUP BY ALL")
def missing_matrix(t):
    return K.missing_matrix(t.missing.select(*MATRIX))


NAMES = ["l_quantity", "l_discount", "l_tax"]


def ols_sql() -> str:
    s = ", ".join([f"covar_pop({a}, {b}) * count(*) AS s{i}{j}" for i, a in enumerate(NAMES, 1) for j, b in enumerate(NAMES, 1) if i <= j]
                  + [f"covar_pop({a}, l_extendedprice) * count(*) AS t{i}, avg({a}) AS m{i}" for i, a in enumerate(NAMES, 1)])
    terms = [("intercept", "a", "se0")] + [(n, f"b{i}", f"se{i}") for i, n in enumerate(NAMES, 1)]
    return f"""WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, var_pop(l_extendedprice) * count(*) AS syy, {s} FROM lineitem),
 d AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS det FROM s),
 i AS (SELECT *, (s22 * s33 - s23 * s23) / det AS i11, (s13 * s23 - s12 * s33) / det AS i12, (s12 * s23 - s13 * s22) / det AS i13,
   (s11 * s33 - s13 * s13) / det AS i22, (s12 * s13 - s11 * s23) / det AS i23, (s11 * s22 - s12 * s12) / det AS i33 FROM d),
 b AS (SELECT *, i11 * t1 + i12 * t2 + i13 * t3 AS b1, i12 * t1 + i22 * t2 + i23 * t3 AS b2, i13 * t1 + i23 * t2 + i33 * t3 AS b3 FROM i),
 e AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS a, (syy - b1 * t1 - b2 * t2 - b3 * t3) / (n - 4) AS mse FROM b),
 f AS (SELECT *, 1 - mse * (n - 4) / syy AS r2, sqrt(mse * i11) AS se1, sqrt(mse * i22) AS se2, sqrt(mse * i33) AS se3,
   sqrt(mse * (1.0 / n + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * m1 * m2 * i12 + 2 * m1 * m3 * i13 + 2 * m2 * m3 * i23)) AS se0 FROM e)
 """ + "\nUNION ALL\n".join(f"SELECT '{t}' AS term, {rnd(c)} AS coefficient, {rnd(se)} AS std_error, {rnd(f'{c} / {se}')} AS t, n, {rnd('r2', 6)} AS r_squared, {rnd('mse', 1)} AS mse FROM f"
                             for t, c, se in terms)


@query("linear_regression", ols_sql())
def linear_regression(t):
    return rounded(G.linear_regression(t.lineitem, NAMES, "l_extendedprice").drop("p_value"), 4, r_squared=6, mse=1)


SIMPLE = f"""regr_count(y, x) AS n, {rnd('regr_slope(y, x)')} AS slope, {rnd('regr_intercept(y, x)')} AS intercept, {rnd('corr(y, x)', 6)} AS r,
 {rnd('regr_r2(y, x)', 6)} AS r_squared, {rnd('sqrt((regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x))')} AS std_error"""


@query("simple_regression", f"SELECT l_returnflag, {SIMPLE} FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x FROM lineitem) GROUP BY ALL")
def simple_regression(t):
    return rounded(G.simple_regression(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("p_value"), 4, r=6, r_squared=6)


@query("linear_regression_by_group", f"SELECT l_returnflag, 'l_quantity' AS term, {rnd('regr_slope(l_extendedprice, l_quantity)')} AS coefficient FROM lineitem GROUP BY ALL "
       f"UNION ALL SELECT l_returnflag, 'intercept', {rnd('regr_intercept(l_extendedprice, l_quantity)')} FROM lineitem GROUP BY ALL")
def linear_regression_by_group(t):
    return rounded(G.linear_regression(t.lineitem, ["l_quantity"], "l_extendedprice", ["l_returnflag"])
                   .select("l_returnflag", "term", "coefficient"))
