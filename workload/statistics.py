"""Grouped aggregate, correlation, test and experiment queries."""

from __future__ import annotations

from tabsonde.functions.normal import (AS241_CENTRE, AS241_MIDDLE, AS241_TAIL, HART_DENOMINATOR,
                                       HART_NUMERATOR)
from tabsonde.operators import correlation as R
from tabsonde.operators import experiment as E
from tabsonde.operators import grouping as G
from tabsonde.operators import hypothesis as H
from workload.common import LINE_NUMERIC, query, rnd, rounded, union_all


def horner(cs, x: str) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * ({x}) + {c!r})"
    return out


def ppf_sql(p: str) -> str:
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    r0 = f"(0.180625 - {q} * {q})"
    return (f"CASE WHEN abs{q} <= 0.425 THEN {q} * {horner(AS241_CENTRE[0], r0)} / {horner(AS241_CENTRE[1], r0)} "
            f"WHEN {r} <= 5 THEN sign{q} * {horner(AS241_MIDDLE[0], f'({r} - 1.6)')} / {horner(AS241_MIDDLE[1], f'({r} - 1.6)')} "
            f"ELSE sign{q} * {horner(AS241_TAIL[0], f'({r} - 5.0)')} / {horner(AS241_TAIL[1], f'({r} - 5.0)')} END")


def cdf_sql(z: str) -> str:
    a = f"abs({z})"
    t = f"exp(-{a} * {a} / 2) * {horner(HART_NUMERATOR, a)} / {horner(HART_DENOMINATOR, a)}"
    return f"CASE WHEN {z} > 0 THEN 1 - {t} ELSE {t} END"


@query("group_mean", f"SELECT o_orderpriority, {rnd('avg(o_totalprice)')} AS mean FROM orders GROUP BY ALL")
def group_mean(t):
    return rounded(G.group_mean(t.orders, ["o_orderpriority"], "o_totalprice"))


@query("group_count_sorted", "SELECT l_linenumber, count(discount_m) AS n FROM fx_missing GROUP BY ALL")
def group_count_sorted(t):
    return rounded(G.group_count(t.missing, ["l_linenumber"], "discount_m"))


@query("group_proportion", f"""SELECT event_type, count(value) AS n, {rnd('count(value) * 100.0 / sum(count(value)) OVER ()')} AS percent
 FROM events GROUP BY event_type""")
def group_proportion(t):
    return rounded(G.group_share(t.events, ["event_type"], "value"))


@query("group_agg", f"""SELECT l_returnflag, l_linestatus, {rnd('sum(l_quantity)')} AS l_quantity_sum, {rnd('avg(l_extendedprice)')} AS l_extendedprice_mean,
 {rnd('stddev_samp(l_extendedprice)')} AS l_extendedprice_std, count(l_discount) AS l_discount_count, count(DISTINCT l_partkey) AS l_partkey_nunique,
 min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max FROM lineitem GROUP BY ALL""")
def group_agg(t):
    return rounded(G.group_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "l_quantity": "sum", "l_extendedprice": ["mean", "std"], "l_discount": "count",
        "l_partkey": "nunique", "l_tax": ["min", "max"]}))


@query("crosstab", f"""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
 g AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM c), (SELECT DISTINCT l_linestatus FROM c))
 SELECT l_returnflag, l_linestatus, coalesce(n, 0) AS n, {rnd('sum(coalesce(n, 0)) OVER (PARTITION BY l_returnflag) * sum(coalesce(n, 0)) OVER (PARTITION BY l_linestatus) / sum(coalesce(n, 0)) OVER ()')} AS expected
 FROM g LEFT JOIN c USING (l_returnflag, l_linestatus)""")
def crosstab(t):
    return rounded(G.crosstab(t.lineitem, "l_returnflag", "l_linestatus", zeros=True))


PAIRS = [(a, b) for i, a in enumerate(LINE_NUMERIC) for b in LINE_NUMERIC[i + 1:]]


@query("correlation_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, count(*) AS n, {rnd(f'corr({a}, {b})', 6)} AS r FROM lineitem" for a, b in PAIRS))
def correlation_matrix(t):
    return rounded(R.correlation_matrix(t.lineitem, LINE_NUMERIC), 6)


def avg_rank(c: str, part: str = "") -> str:
    return f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {part.replace('PARTITION BY ', '').strip() + ', ' if part else ''}{c}) - 1) / 2.0"


@query("correlation_rank_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, count(*) AS n, {rnd('corr(x, y)', 6)} AS r FROM "
    f"(SELECT {avg_rank(a)} AS x, {avg_rank(b)} AS y FROM lineitem)" for a, b in PAIRS))
def correlation_rank_matrix(t):
    return rounded(R.rank_correlation_matrix(t.lineitem, LINE_NUMERIC), 6)


def test_sql(name: str, source: str, x: str, y: str) -> str:
    return f"SELECT '{name}' AS method, count(*) AS n, {rnd(f'corr({x}, {y})', 6)} AS correlation FROM ({source})"


@query("corr_test", test_sql("pearson", "SELECT * FROM fx_missing WHERE discount_m IS NOT NULL AND quantity_mcar IS NOT NULL",
                             "discount_m", "quantity_mcar"))
def corr_test(t):
    return rounded(R.correlation_test(t.missing, "discount_m", "quantity_mcar", "pearson").drop("p_value"), 6)


@query("corr_test_spearman", f"""SELECT l_returnflag, 'spearman' AS method, count(*) AS n, {rnd('corr(x, y)', 6)} AS correlation FROM
 (SELECT l_returnflag, {avg_rank('l_extendedprice', 'PARTITION BY l_returnflag ')} AS x, {avg_rank('l_quantity', 'PARTITION BY l_returnflag ')} AS y FROM lineitem)
 GROUP BY l_returnflag""")
def corr_test_spearman(t):
    return rounded(R.correlation_test(t.lineitem, "l_extendedprice", "l_quantity", "spearman", ["l_returnflag"]).drop("p_value"), 6)


def kendall_sql(table: str, x: str, y: str) -> str:
    return f"""WITH c AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {table} GROUP BY ALL),
 s AS (SELECT sum(CAST(a.n AS DOUBLE) * b.n * sign((a.x - b.x) * (a.y - b.y))) AS s FROM c a, c b WHERE a.x < b.x),
 tx AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT CAST(sum(n) AS DOUBLE) AS m FROM c GROUP BY x)),
 ty AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT CAST(sum(n) AS DOUBLE) AS m FROM c GROUP BY y)),
 tt AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM c)
 SELECT 'kendall' AS method, CAST(n AS BIGINT) AS n, {rnd('s / (sqrt(n * (n - 1) / 2 - tx.t) * sqrt(n * (n - 1) / 2 - ty.t))', 6)} AS correlation
 FROM s, tx, ty, tt"""


@query("corr_test_kendall", kendall_sql("lineitem", "l_quantity", "l_discount"))
def corr_test_kendall(t):
    return rounded(R.correlation_test(t.lineitem, "l_quantity", "l_discount", "kendall").drop("p_value"), 6)


@query("corr_test_kendall_continuous", kendall_sql("customer", "c_acctbal", "c_custkey"))
def corr_test_kendall_continuous(t):
    return rounded(R.correlation_test(t.customer, "c_acctbal", "c_custkey", "kendall").drop("p_value"), 6)


CHI = """c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} GROUP BY ALL),
 g AS (SELECT ra.a, cb.b, coalesce(o, 0) AS o, r * cc / CAST(n AS DOUBLE) AS e FROM (SELECT a, sum(o) AS r FROM c GROUP BY a) ra
   CROSS JOIN (SELECT b, sum(o) AS cc FROM c GROUP BY b) cb CROSS JOIN (SELECT sum(o) AS n FROM c) LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
 d AS (SELECT CAST(sum(o) AS BIGINT) AS n, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS m,
   sum((o - e) * (o - e) / e) AS plain, sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS yates FROM g),
 x AS (SELECT *, CASE WHEN dof = 1 THEN yates ELSE plain END AS chi2 FROM d)
 SELECT n, {chi} AS chi2, dof, {v} AS cramers_v FROM x"""


def chi_sql(table, a, b):
    return "WITH " + CHI.format(t=table, a=a, b=b, chi=rnd("chi2"), v=rnd("sqrt(chi2 / (n * m))", 6))


@query("chi_square", chi_sql("lineitem", "l_returnflag", "l_linestatus"))
def chi_square(t):
    return rounded(H.chi_square(t.lineitem, "l_returnflag", "l_linestatus").drop("p_value"), 4, cramers_v=6)


@query("chi_square_yates", chi_sql("fx_two_by_two", "a", "b"))
def chi_square_yates(t):
    return rounded(H.chi_square(t.two_by_two, "a", "b").drop("p_value"), 4, cramers_v=6)


def anova_cte(source: str, g: str, v: str, by: str = "") -> str:
    """CTE `an` with k, n, f for a source."""
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""gm AS (SELECT {keys}{g}, count({v}) AS gn, avg({v}) AS gmean, var_pop({v}) AS gv FROM {source} GROUP BY ALL),
 an AS (SELECT {keys}count(*) AS k, CAST(sum(gn) AS BIGINT) AS n, sum(gn * gv) AS ssw,
   sum(gn * gmean * gmean) - power(sum(gn * gmean), 2) / sum(gn) AS ssb FROM gm {grp}),
 fx AS (SELECT *, k - 1 AS df_between, n - k AS df_within, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM an)"""


@query("anova", f"""WITH {anova_cte('orders', 'o_orderpriority', 'o_totalprice')}
 SELECT n, k, df_between, df_within, {rnd('f')} AS f FROM fx""")
def anova(t):
    return rounded(H.anova(t.orders, "o_orderpriority", "o_totalprice").drop("p_value"))


@query("anova_by_group", f"""WITH {anova_cte('orders', 'o_orderpriority', 'o_totalprice', 'o_orderstatus')}
 SELECT o_orderstatus, n, k, df_between, df_within, {rnd('f')} AS f FROM fx""")
def anova_by_group(t):
    return rounded(H.anova(t.orders, "o_orderpriority", "o_totalprice", ["o_orderstatus"]).drop("p_value"))


def levene_cte(source, g, v, by=""):
    keys = f"{by}, " if by else ""
    return f"""md AS (SELECT {keys}{g}, quantile_cont({v}, 0.5) AS md FROM {source} GROUP BY ALL),
 dv AS (SELECT {keys}{g}, abs({v} - md) AS dev FROM {source} JOIN md USING ({keys}{g})),
 {anova_cte('dv', g, 'dev', by)}"""


@query("levene", f"""WITH {levene_cte('orders', 'o_orderpriority', 'o_totalprice')}
 SELECT n, k, df_between, df_within, {rnd('f')} AS w FROM fx""")
def levene(t):
    return rounded(H.levene(t.orders, "o_orderpriority", "o_totalprice").drop("p_value"))


def t_test_sql(source: str, g: str, v: str) -> str:
    return f"""WITH {levene_cte(source, g, v)},
 m AS (SELECT {g} AS g, count({v}) AS n, avg({v}) AS m, stddev_samp({v}) AS s FROM {source} GROUP BY ALL),
 p AS (SELECT a.g AS group_1, a.n AS n1, a.m AS m1, a.s AS s1, b.g AS group_2, b.n AS n2, b.m AS m2, b.s AS s2 FROM m a JOIN m b ON a.g < b.g),
 -- 3.8414588 is the 5 % point of F(1, infinity); with these row counts the difference is below 1e-3
 w AS (SELECT p.*, f, f < 3.8414588 AS eq FROM p, fx),
 r AS (SELECT *, ((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2) AS vp, s1 * s1 / n1 AS a, s2 * s2 / n2 AS b FROM w)
 SELECT CAST(2 AS BIGINT) AS n_groups, group_1, n1 AS n_1, {rnd('m1')} AS mean_1, {rnd('s1')} AS std_1, group_2, n2 AS n_2, {rnd('m2')} AS mean_2, {rnd('s2')} AS std_2,
 {rnd('f')} AS levene_w, eq AS equal_var,
 {rnd('CASE WHEN eq THEN (m1 - m2) / sqrt(vp * (1.0 / n1 + 1.0 / n2)) ELSE (m1 - m2) / sqrt(a + b) END')} AS statistic,
 {rnd('CASE WHEN eq THEN n1 + n2 - 2 ELSE (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) END')} AS dof,
 {rnd('(m1 - m2) / sqrt((s1 * s1 + s2 * s2) / 2)')} AS effect_size FROM r"""


@query("t_test", t_test_sql("fx_two_arm", "arm", "metric"))
def t_test(t):
    return rounded(H.t_test(t.two_arm, "arm", "metric").drop("p_value", "levene_p"))


@query("t_test_paired", f"""WITH b AS (SELECT o_custkey AS k, 'first_half' AS g, sum(CASE WHEN month(o_orderdate) <= 6 THEN o_totalprice ELSE 0 END) AS v FROM orders GROUP BY ALL
 UNION ALL SELECT o_custkey, 'second_half', sum(CASE WHEN month(o_orderdate) > 6 THEN o_totalprice ELSE 0 END) FROM orders GROUP BY ALL),
 d AS (SELECT a.v - c.v AS d FROM b a JOIN b c ON a.k = c.k WHERE a.g = 'first_half' AND c.g = 'second_half')
 SELECT 'first_half' AS group_1, 'second_half' AS group_2, CAST(2 AS BIGINT) AS n_groups, count(*) AS n_pairs, {rnd('avg(d)')} AS mean_difference,
 {rnd('stddev_samp(d)')} AS std_difference, {rnd('avg(d) * sqrt(count(*)) / stddev_samp(d)')} AS statistic, count(*) - 1 AS dof FROM d""")
def t_test_paired(t):
    halves = t.orders.selectExpr("o_custkey", "o_totalprice", "month(o_orderdate) <= 6 AS early").selectExpr(
        "o_custkey", "inline(array(struct('first_half' AS half, CASE WHEN early THEN o_totalprice ELSE 0D END AS v), "
        "struct('second_half' AS half, CASE WHEN early THEN 0D ELSE o_totalprice END AS v)))")
    spend = halves.groupBy("o_custkey", "half").agg({"v": "sum"}).withColumnRenamed("sum(v)", "spend")
    return rounded(H.paired_t_test(spend, "half", "spend", ["o_custkey"]).drop("p_value"))


@query("normality_jb", f"""SELECT o_orderstatus, count(o_totalprice) AS n, {rnd('count(o_totalprice) / 6.0 * (s * s + k * k / 4)')} AS statistic,
 {rnd('exp(-count(o_totalprice) / 6.0 * (s * s + k * k / 4) / 2)', 6)} AS p_value FROM (SELECT *, s3 / power(s2, 1.5) AS s, s4 / (s2 * s2) - 3 AS k FROM
 (SELECT o_orderstatus, o_totalprice, avg(power(c, 2)) OVER w AS s2, avg(power(c, 3)) OVER w AS s3, avg(power(c, 4)) OVER w AS s4 FROM
 (SELECT *, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS c FROM orders) WINDOW w AS (PARTITION BY o_orderstatus))) GROUP BY o_orderstatus, s, k""")
def normality_jb(t):
    return rounded(H.normality_jarque_bera(t.orders, "o_totalprice", ["o_orderstatus"]), 4, p_value=6)


ZED = """s AS (SELECT avg({v}) AS mu, stddev_samp({v}) AS sd, count({v}) AS n FROM {t}),
 z AS (SELECT ({v} - mu) / sd AS z, n, row_number() OVER (ORDER BY {v}) AS i FROM {t}, s)"""


@query("normality_ks", f"""WITH {ZED.format(v='o_totalprice', t='orders')}, c AS (SELECT *, {cdf_sql('z')} AS c FROM z)
 SELECT n, {rnd('max(greatest(i / n - c, c - (i - 1) / n))', 6)} AS statistic FROM c GROUP BY n""")
def normality_ks(t):
    return rounded(H.normality_ks(t.orders, "o_totalprice").drop("p_value"), 6)


AD_CRITICAL = ", ".join(f"round({c} / (1 + 4.0 / n - 25.0 / (n * n)), 3) AS critical_{k[:-1].replace('.', '_')}"
                        for k, c in H.ANDERSON_LEVELS.items())


@query("normality_ad", f"""WITH {ZED.format(v='o_totalprice', t='orders')}, c AS (SELECT *, {cdf_sql('z')} AS c, {cdf_sql('(-z)')} AS u FROM z),
 a AS (SELECT n, -n - sum((2 * i - 1) * ln(c) + (2 * (n - i) + 1) * ln(u)) / n AS a FROM c GROUP BY n)
 SELECT n, {rnd('a')} AS statistic, {AD_CRITICAL}, CASE WHEN a > 1.092 THEN '1%' END AS rejected_at FROM a""")
def normality_ad(t):
    return rounded(H.normality_anderson(t.orders, "o_totalprice"))


@query("normality_shapiro", f"""WITH v AS (SELECT l_suppkey, l_extendedprice AS x, count(*) OVER w AS n, avg(l_extendedprice) OVER w AS mu,
   row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
 p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM v),
 q AS (SELECT *, {ppf_sql('p')} AS q FROM p),
 s AS (SELECT *, sum(q * q) OVER (PARTITION BY l_suppkey) AS ssq, max(q) OVER (PARTITION BY l_suppkey) AS q1,
   max(CASE WHEN i = n - 1 THEN q END) OVER (PARTITION BY l_suppkey) AS q2, 1 / sqrt(n) AS u FROM q),
 e AS (SELECT *, {horner([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], 'u')} + q1 / sqrt(ssq) AS an,
   {horner([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], 'u')} + q2 / sqrt(ssq) AS an1 FROM s),
 w AS (SELECT *, CASE WHEN i = n THEN an WHEN i = 1 THEN -an WHEN i = n - 1 THEN an1 WHEN i = 2 THEN -an1
   ELSE q / sqrt((ssq - 2 * q1 * q1 - 2 * q2 * q2) / (1 - 2 * an * an - 2 * an1 * an1)) END AS a FROM e)
 SELECT l_suppkey, n, {rnd('power(sum(a * x), 2) / sum(power(x - mu, 2))', 6)} AS statistic FROM w GROUP BY l_suppkey, n""")
def normality_shapiro(t):
    return rounded(H.normality_shapiro(t.lineitem, "l_extendedprice", ["l_suppkey"]).drop("p_value", "reason"), 6)


@query("ab_statistics", f"""SELECT arm, count(metric) AS n, {rnd('avg(metric)')} AS mean, {rnd('stddev_samp(metric)')} AS std,
 {rnd('stddev_samp(metric) / sqrt(count(metric))')} AS se FROM fx_two_arm GROUP BY arm""")
def ab_statistics(t):
    return rounded(E.arm_statistics(t.two_arm, "arm", "metric"))


ARMS = """m AS (SELECT {keys}count(*) FILTER (arm = 'control') AS n1, count(*) FILTER (arm = 'treatment') AS n2, avg({v}) FILTER (arm = 'control') AS m1,
 avg({v}) FILTER (arm = 'treatment') AS m2, var_samp({v}) FILTER (arm = 'control') AS v1, var_samp({v}) FILTER (arm = 'treatment') AS v2 FROM fx_two_arm GROUP BY ALL)"""


@query("ab_t_test", f"""WITH {ARMS.format(keys='l_returnflag, ', v='metric')} SELECT l_returnflag, 'control' AS control, 'treatment' AS treatment, n1 AS n_1, n2 AS n_2,
 {rnd('(m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))')} AS statistic, n1 + n2 - 2 AS dof FROM m""")
def ab_t_test(t):
    return rounded(E.t_test(t.two_arm, "arm", "metric", control="control", by=["l_returnflag"])
                   .drop("p_value", "is_significant"))


@query("ab_effect_ci", f"""WITH {ARMS.format(keys='', v='metric')}, e AS (SELECT m2 - m1 AS difference, sqrt(v1 / n1 + v2 / n2) AS se, (m2 - m1) / sqrt((v1 + v2) / 2) AS d, n1 + n2 - 2 AS dof FROM m),
 -- Cornish-Fisher expansion of the t quantile around the normal quantile
 c AS (SELECT *, 1.959963984540054 + (power(1.959963984540054, 3) + 1.959963984540054) / (4 * dof)
   + (5 * power(1.959963984540054, 5) + 16 * power(1.959963984540054, 3) + 3 * 1.959963984540054) / (96.0 * dof * dof) AS q FROM e)
 SELECT 'control' AS control, 'treatment' AS treatment, {rnd('difference')} AS difference, {rnd('se')} AS se, {rnd('d')} AS effect_size,
 CASE WHEN abs(d) < 0.2 THEN 'very small' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size,
 {rnd('difference - q * se', 3)} AS ci_low, {rnd('difference + q * se', 3)} AS ci_high FROM c""")
def ab_effect_ci(t):
    return rounded(E.effect(t.two_arm, "arm", "metric", control="control"), 4, ci_low=3, ci_high=3)


@query("ab_mann_whitney", f"""WITH r AS (SELECT arm, {avg_rank('metric')} AS r FROM fx_two_arm),
 tie AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS t FROM (SELECT count(*) AS c FROM fx_two_arm GROUP BY metric)),
 u AS (SELECT count(*) FILTER (arm = 'control') AS n_1, count(*) FILTER (arm = 'treatment') AS n_2, CAST(count(*) AS DOUBLE) AS n,
   sum(r) FILTER (arm = 'treatment') AS r2 FROM r),
 s AS (SELECT *, r2 - CAST(n_2 AS DOUBLE) * (n_2 + 1) / 2 AS u FROM u)
 SELECT n_1, n_2, {rnd('u')} AS statistic, {rnd('(abs(u - CAST(n_1 AS DOUBLE) * n_2 / 2) - 0.5) / sqrt(CAST(n_1 AS DOUBLE) * n_2 / 12 * (n + 1 - t / (n * (n - 1))))')} AS z FROM s, tie""")
def ab_mann_whitney(t):
    return rounded(E.mann_whitney(t.two_arm, "arm", "metric").drop("p_value"))


@query("ab_sample_size", "WITH " + ", ".join(f"m{i} AS ({ARMS.format(keys='', v=v)[6:-1]})" for i, v in enumerate(["metric", "l_quantity"]))
       + ", e AS (" + union_all([0, 1], lambda i: f"SELECT '{['metric', 'l_quantity'][i]}' AS metric, (m2 - m1) / sqrt((v1 + v2) / 2) AS d, n1, n2 FROM m{i}") + ")"
       + f""" SELECT metric, {rnd('d')} AS effect_size, n1 AS n_1, n2 AS n_2,
 CAST(ceil(2 * power(1.959963984540054 + 0.8416212335729143, 2) / (d * d) + power(1.959963984540054, 2) / 4) AS BIGINT) AS required_n,
 least(n1, n2) >= ceil(2 * power(1.959963984540054 + 0.8416212335729143, 2) / (d * d) + power(1.959963984540054, 2) / 4) AS enough FROM e""")
def ab_sample_size(t):
    return rounded(E.sample_size(t.two_arm, "arm", ["metric", "l_quantity"], control="control"))
