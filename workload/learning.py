"""Clustering, anomaly, model-comparison and prediction queries (no SQL: randomised or iterative)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabsonde.operators import clustering as C
from tabsonde.operators import models as M
from tabsonde.operators import regression as G
from workload.common import LINE_NUMERIC, LINE_ORDER, query, rnd, rounded, union_all

VECTOR = [f"e{i}" for i in range(64)]


def vectors(t):
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR)])


@query("kmeans")
def kmeans(t):
    return rounded(C.kmeans(t.lineitem, LINE_NUMERIC, 3))


GIVEN = [[10.0, 20000.0, 0.02, 0.02], [25.0, 40000.0, 0.05, 0.04], [40.0, 60000.0, 0.08, 0.06]]


def nearest_sql() -> str:
    """Sizes and means of the rows next to each of the centres GIVEN, by distance in standard deviations."""
    spread = ", ".join(f"stddev_samp({c}) AS s{i}" for i, c in enumerate(LINE_NUMERIC))
    far = [" + ".join(f"power(({c} - {v!r}) / s{i}, 2)" for i, (c, v) in enumerate(zip(LINE_NUMERIC, centre))) for centre in GIVEN]
    best = "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
    return f"""WITH m AS (SELECT {spread} FROM lineitem), d AS (SELECT *, {', '.join(f'{f} AS d{i}' for i, f in enumerate(far))} FROM lineitem, m),
 c AS (SELECT *, CAST({best} AS BIGINT) AS cluster FROM d)
 """ + union_all(LINE_NUMERIC, lambda c: f"SELECT cluster, count(*) AS size, '{c}' AS column_name, {rnd(f'avg({c})', 6)} AS mean FROM c GROUP BY cluster")


@query("kmeans_nearest", nearest_sql())
def kmeans_nearest(t):
    scaled = C.Scaled(t.lineitem, LINE_NUMERIC)
    return rounded(C.cluster_profile(C.assign(scaled, (np.array(GIVEN) - scaled.mean) / scaled.std), LINE_NUMERIC), 6)


@query("pca")
def pca(t):
    return rounded(C.principal_components(vectors(t), VECTOR, 3))


@query("pca_project")
def pca_project(t):
    return rounded(C.project(vectors(t), VECTOR, ["vec_id"], 3))


@query("isolation_forest")
def isolation_forest(t):
    return rounded(C.anomalies(t.outliers, ["price_o", "quantity_zero"], 0.1, LINE_ORDER))


@query("isolation_forest_summary")
def isolation_forest_summary(t):
    return rounded(C.anomaly_summary(t.outliers, ["price_o", "quantity_zero"]))


def det(m: list[list[str]]) -> str:
    """A determinant in SQL, by its first row."""
    if len(m) == 1:
        return m[0][0]
    minors = [[row[:j] + row[j + 1:] for row in m[1:]] for j in range(len(m))]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * {det(minors[j])}" for j in range(len(m))) + ")"


def least_squares(name: str, source: str, xs: list[str], y: str) -> str:
    """CTEs that end in `name` (b0, b1 ..): the coefficients of y on xs over the rows of `source`, by Cramer's rule."""
    k = range(len(xs))
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    sums = [f"covar_pop({xs[i]}, {xs[j]}) AS s{i}{j}" for i in k for j in k if i <= j]
    sums += [f"covar_pop({x}, {y}) AS c{i}, avg({x}) AS m{i}" for i, x in enumerate(xs)]
    m = [[s(i, j) for j in k] for i in k]
    beta = [f"{det([[f'c{i}' if j == at else m[i][j] for j in k] for i in k])} / {det(m)} AS b{at + 1}" for at in k]
    return (f"{name}_s AS (SELECT {', '.join(sums)}, avg({y}) AS my FROM {source}),\n {name}_b AS (SELECT *, {', '.join(beta)} FROM {name}_s),\n"
            f" {name} AS (SELECT {', '.join(f'b{i + 1}' for i in k)}, my - {' - '.join(f'b{i + 1} * m{i}' for i in k)} AS b0 FROM {name}_b)")


def bucket(key: list[str], seed: int, buckets: int) -> str:
    text = " || '|' || ".join([f"CAST({k} AS VARCHAR)" for k in key] + [f"'{seed}'"])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {buckets}"


def predicted(xs: list[str]) -> str:
    return "b0 + " + " + ".join(f"b{i + 1} * {x}" for i, x in enumerate(xs))


def predictive_sql(table: str, xs: list[str], y: str, key: list[str]) -> str:
    """CTEs that end in `fit` (rank, feature, coefficient, importance, r2, rmse, n_test)."""
    return f"""a AS (SELECT *, {bucket(key, 42, 10)} AS split FROM {table}), tr AS (SELECT * FROM a WHERE split < 8), {least_squares('ols', 'tr', xs, y)},
 sc AS (SELECT 1 - sum(power({y} - ({predicted(xs)}), 2)) / (var_pop({y}) * count(*)) AS r2, sqrt(avg(power({y} - ({predicted(xs)}), 2))) AS rmse, count(*) AS n_test
   FROM a, ols WHERE split >= 8),
 co AS ({union_all([str(i) for i in range(len(xs))], lambda i: f"SELECT '{xs[int(i)]}' AS feature, b{int(i) + 1} AS coefficient FROM ols")}),
 fit AS (SELECT row_number() OVER (ORDER BY abs(coefficient) DESC, feature DESC) AS rank, feature, coefficient, abs(coefficient) AS importance, r2, rmse, n_test FROM co, sc)"""


PREDICTORS, LINE_KEY = ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("predictive_analysis", f"""WITH {predictive_sql('lineitem', PREDICTORS, 'l_extendedprice', LINE_KEY)}
 SELECT rank, feature, {rnd('coefficient', 3)} AS coefficient, {rnd('importance', 3)} AS importance, {rnd('r2', 6)} AS r2, {rnd('rmse', 3)} AS rmse, n_test FROM fit""")
def predictive_analysis(t):
    return rounded(G.predictive_analysis(t.lineitem, PREDICTORS, "l_extendedprice", LINE_KEY), 3, r2=6)


def labelled(t):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "quality", "n_chars", F.size(F.split("text", " ")).alias("n_words"),
        F.size(F.split("text", "\n")).alias("n_lines"))


@query("task_type", """SELECT 'p_size' AS column_name, count(DISTINCT p_size) AS n_unique, 'regression' AS task FROM part
 UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), 'classification' FROM part""")
def task_type(t):
    return M.task_type(t.part, "p_size").unionByName(M.task_type(t.part, "p_brand"))


@query("model_evaluate_classification")
def model_evaluate_classification(t):
    return rounded(M.evaluate_models(labelled(t), "quality", ["doc_id"], ["n_chars", "n_words", "n_lines"]))


@query("model_evaluate_regression")
def model_evaluate_regression(t):
    return rounded(M.evaluate_models(t.part, "p_retailprice", ["p_partkey"], ["p_partkey", "p_size"]))


def linear_scores(table: str, xs: list[str], y: str, key: list[str]) -> str:
    """Root mean squared errors of linear models on the hold-out part and over five folds."""
    error = f"avg(power({y} - ({predicted(xs)}), 2))"
    folds = range(M.FOLDS)
    fits = ",\n ".join(f"f{f} AS (SELECT * FROM a WHERE fold <> {f}), {least_squares(f'o{f}', f'f{f}', xs, y)}" for f in folds)
    each = " UNION ALL ".join(f"SELECT {error} AS e FROM a, o{f} WHERE fold = {f}" for f in folds)
    return f"""WITH a AS (SELECT *, {bucket(key, 42, 10)} AS split, {bucket(key, 7, M.FOLDS)} AS fold FROM {table}), tr AS (SELECT * FROM a WHERE split < 8),
 {least_squares('ols', 'tr', xs, y)}, {fits}, h AS (SELECT sqrt({error}) AS score FROM a, ols WHERE split >= 8), c AS (SELECT sqrt(avg(e)) AS cv FROM ({each}))
 SELECT 'linear' AS model, {rnd('score')} AS score, {rnd('cv')} AS cv_score FROM h, c"""


@query("model_linear_scores", linear_scores("part", ["p_partkey", "p_size"], "p_retailprice", ["p_partkey"]))
def model_linear_scores(t):
    got = M.evaluate_models(t.part, "p_retailprice", ["p_partkey"], ["p_partkey", "p_size"], models=["linear"])
    return rounded(got.select("model", "score", "cv_score"))


@query("model_kernel_scores")
def model_kernel_scores(t):
    return rounded(M.evaluate_models(t.part, "p_retailprice", ["p_partkey"], ["p_partkey", "p_size"], models=["linear", "kernel"]))


@query("model_candidates")
def model_candidates(t):
    return rounded(M.evaluate_models(t.customer, "c_mktsegment", ["c_custkey"], ["c_acctbal", "c_nationkey"]))
