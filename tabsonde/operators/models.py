"""Task type, candidate models and their comparison by hold-out and cross-validation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsonde.operators.regression import split_bucket
from tabsonde.schema import as_double, is_categorical, missing, numeric_columns, require_columns

CLASS_LIMIT, FOLDS, TREES, RANDOM_FEATURES = 10, 5, 100, 64
COMPLEXITY = {"linear": "low", "random_forest": "medium", "kernel": "high"}


def task_type(df: DataFrame, target: str) -> DataFrame:
    """(column_name, n_unique, task): text or fewer than ten distinct values means classification."""
    require_columns(df, [target])
    text = F.lit(is_categorical(df.schema[target].dataType))
    return (df.agg(F.count_distinct(F.when(~missing(df, target), F.col(target))).alias("n_unique"))
            .select(F.lit(target).alias("column_name"), "n_unique",
                    F.when(text | (F.col("n_unique") < CLASS_LIMIT), "classification").otherwise("regression").alias("task")))


class RandomFeatures:
    """cos(w x + b) of the standardised inputs; an inner product of these approximates the RBF kernel with gamma
    1 / number of columns."""

    def __init__(self, rows: DataFrame, inputs: Sequence[str], count: int = RANDOM_FEATURES):
        facts = rows.agg(*[e for c in inputs for e in (F.avg(c), F.stddev_pop(c))]).first()
        rng = np.random.default_rng(42)
        p = len(inputs)
        self.inputs, self.count = list(inputs), count
        self.mean, self.std = np.array([v or 0.0 for v in facts[::2]], float), np.array([v or 1.0 for v in facts[1::2]], float)
        self.w, self.b = rng.normal(0.0, math.sqrt(2.0 / p), (count, p)), rng.uniform(0.0, 2 * math.pi, count)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.cos((x - self.mean) / self.std @ self.w.T + self.b) * math.sqrt(2.0 / self.count)

    def add(self, rows: DataFrame) -> DataFrame:
        """Add them as columns `_z0` .. ."""
        cells = []
        for i in range(self.count):
            angle = F.lit(float(self.b[i]))
            for j, c in enumerate(self.inputs):
                angle = angle + F.lit(float(self.w[i, j])) * ((F.col(c) - F.lit(float(self.mean[j]))) / F.lit(float(self.std[j])))
            cells.append((F.cos(angle) * F.lit(math.sqrt(2.0 / self.count))).alias(f"_z{i}"))
        return rows.select("*", *cells)


RIDGE = 0.01  # of the kernel model, on standardised features


def _cell_sums(rows: DataFrame, inputs: Sequence[str], spread: RandomFeatures | None) -> np.ndarray:
    """Sums of products of 1, the inputs, their random features and `_y`, for every fold of both hold-out parts, from
    one scan: array (2, FOLDS, m, m). A task sends m rows for each cell, and one row of each is what the driver gets."""
    p = len(inputs)
    m = p + 2 + (spread.count if spread else 0)

    def part(batches):
        total = np.zeros((2 * FOLDS, m, m))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs], 1).astype(float)
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(float)
            full = np.column_stack([np.ones(len(x)), x, *([spread.of(x)] if spread else []), y])
            cell = (batch.column("_hold").to_numpy() >= 8) * FOLDS + batch.column("_fold").to_numpy()
            for c in np.unique(cell):
                own = full[cell == c]
                total[c] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(2 * FOLDS), m)), pa.array(np.tile(np.arange(m), 2 * FOLDS)),
                                          pa.array(total.reshape(-1, m).tolist(), pa.list_(pa.float64()))], names=["cell", "i", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = np.stack(table.column("v").to_numpy(zero_copy_only=False))
        return pa.table([table.column("cell").slice(0, 1), table.column("i").slice(0, 1), pa.array([v.sum(0).tolist()], pa.list_(pa.float64()))],
                        names=["cell", "i", "v"])

    schema = "cell bigint, i bigint, v array<double>"
    out = np.zeros((2 * FOLDS, m, m))
    for r in rows.select(*inputs, "_y", "_hold", "_fold").mapInArrow(part, schema).groupBy("cell", "i").applyInArrow(add, schema).collect():
        out[r["cell"], r["i"]] = r["v"]
    return out.reshape(2, FOLDS, m, m)


def _squared_error(train: np.ndarray, test: np.ndarray, ridge: float) -> float:
    """Mean squared error on the rows behind the sums `test` of the linear model fitted on those behind `train`. The
    last variable is the target, the first the constant; ridge is relative to the spread of every input."""
    n, mean = train[0, 0], train[0] / max(train[0, 0], 1)
    centred = train[1:, 1:] / max(n, 1) - np.outer(mean[1:], mean[1:])
    inner, cross = centred[:-1, :-1], centred[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(inner), 1e-300))
    beta = np.linalg.pinv(inner / np.outer(scale, scale) + ridge * np.eye(len(scale)), rcond=1e-12, hermitian=True) @ (cross / scale) / scale
    w = np.concatenate([[-(mean[-1] - beta @ mean[1:-1])], -beta, [1.0]])
    return float(max(w @ test @ w, 0.0) / test[0, 0]) if test[0, 0] else math.nan


def _regression_errors(cells: np.ndarray, use: list[int], ridge: float) -> tuple[float, float]:
    """(hold-out, mean over folds) squared errors; training sets are all sums less those of the part left out."""
    pick = cells[:, :, use][:, :, :, use]
    held = _squared_error(pick[0].sum(0), pick[1].sum(0), ridge)
    folds = pick.sum(0)
    errors = [_squared_error(folds.sum(0) - f, f, ridge) for f in folds if f[0, 0] > 0]
    return held, float(np.mean(errors)) if errors else math.nan


def _stages(kind: str, task: str, inputs: Sequence[str], n_classes: int) -> list:
    """Pipeline stages from the input columns to a prediction."""
    scaled = [VectorAssembler(inputCols=list(inputs), outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    if kind == "linear":
        return [*scaled, LogisticRegression(labelCol="_y", tol=1e-4)]
    if kind == "random_forest":
        cls = RandomForestRegressor if task == "regression" else RandomForestClassifier
        return [VectorAssembler(inputCols=list(inputs), outputCol="features"),
                cls(labelCol="_y", numTrees=TREES, seed=42)]
    spread = [VectorAssembler(inputCols=[f"_z{i}" for i in range(RANDOM_FEATURES)], outputCol="features")]
    svc = LinearSVC(labelCol="_y", regParam=0.01, maxIter=20, tol=1e-3)
    return [*spread, svc if n_classes == 2 else OneVsRest(classifier=svc, labelCol="_y")]


def candidates() -> list[str]:
    """The compared models: linear or logistic, random forest, RBF kernel."""
    return list(COMPLEXITY)


def _prepared(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str], task: str) -> DataFrame:
    """Complete rows with `_y`, a hold-out bucket and a fold, both fixed by the row's key."""
    rows = df.select(*[as_double(c).alias(c) for c in features], F.col(target).alias("_t"),
                     split_bucket(key).alias("_hold"), split_bucket(key, 7, FOLDS).alias("_fold")).na.drop()
    if task == "regression":
        return rows.withColumn("_y", F.col("_t").cast("double")).drop("_t")
    rows = rows.withColumn("_t", F.col("_t").cast("string"))
    return StringIndexer(inputCol="_t", outputCol="_y", stringOrderType="alphabetAsc").fit(rows).transform(rows).drop("_t")


ROWS_PER_TASK = 50_000
FITS_AT_ONCE = 3


def _spread_rows(rows: DataFrame) -> DataFrame:
    """Dealt to more tasks where there are fewer than ROWS_PER_TASK asks for and cores are idle: an iteration of a fit is
    a job over all rows, which a table of one file would leave to one core."""
    tasks = rows.rdd.getNumPartitions()
    wanted = min(rows.count() // ROWS_PER_TASK, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(wanted) if wanted > tasks else rows


def evaluate_models(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None,
                    task: str | None = None, models: Sequence[str] | None = None) -> DataFrame:
    """(model, complexity, score, cv_score, performance, is_best, reason).

    Hold-out is a hash split of 80 / 20, cross-validation uses five hash folds. The score is the
    RMSE or the accuracy; performance is 1 / (1 + rmse) or the accuracy. The kernel model is a
    linear model on random Fourier features, an approximation that can be fit on many machines; for regression it
    has a ridge of RIDGE. Linear and kernel regressions take one scan for all their fits; of the others, FITS_AT_ONCE
    run side by side.
    """
    features = list(features or [c for c in numeric_columns(df) if c != target])
    task = task or task_type(df, target).first()["task"]
    prepared = _prepared(df, target, features, key, task).cache()
    rows = prepared if task == "regression" and set(models or candidates()) <= {"linear", "kernel"} else _spread_rows(prepared)
    if rows is not prepared:
        rows = rows.cache()
    metric = "rmse" if task == "regression" else "accuracy"
    if task == "regression":
        evaluator = RegressionEvaluator(labelCol="_y", metricName="mse")
    else:
        evaluator = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")

    def score(kind: str, train: DataFrame, test: DataFrame) -> float:
        return evaluator.evaluate(Pipeline(stages=_stages(kind, task, features, n_classes)).fit(train).transform(test))

    n_classes = 0 if task == "regression" else rows.select("_y").distinct().count()
    results, kinds = [], list(models or candidates())
    closed: dict[str, tuple[float, float]] = {}
    if task == "regression" and {"linear", "kernel"} & set(kinds):
        spread = RandomFeatures(rows, features) if "kernel" in kinds else None
        cells = _cell_sums(rows, features, spread)
        p, last = len(features), cells.shape[-1] - 1
        closed = {"linear": _regression_errors(cells, [*range(p + 1), last], 0.0)}
        if spread:
            closed["kernel"] = _regression_errors(cells, [0, *range(p + 1, last + 1)], RIDGE)
    for kind in kinds:
        used = rows
        if kind in closed:
            held, cv = closed[kind]
        else:
            used = RandomFeatures(rows, features).add(rows).cache() if kind == "kernel" else rows
            parts = [("_hold < 8", "_hold >= 8"), *((f"_fold <> {f}", f"_fold = {f}") for f in range(FOLDS))]
            tasks = [inheritable_thread_target(df.sparkSession)(lambda p=p: score(kind, used.where(p[0]), used.where(p[1]))) for p in parts]
            with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
                held, *errors = pool.map(lambda fit: fit(), tasks)
            cv = float(np.mean(errors))
        if task == "regression":
            held, cv = math.sqrt(held), math.sqrt(cv)
        performance = 1 / (1 + held) if task == "regression" else held
        results.append((kind, COMPLEXITY[kind], metric, held, cv, performance))
        if used is not rows:
            used.unpersist()
    rows.unpersist()
    prepared.unpersist()
    best = max(r[5] for r in results)
    out = df.sparkSession.createDataFrame(
        [(*r, r[5] == best) for r in results],
        "model string, complexity string, metric string, score double, cv_score double, performance double, is_best boolean")
    reason = (F.when(F.col("complexity") == "low", "simple and easy to explain; a good first choice")
              .when(F.col("complexity") == "medium", "follows nonlinear patterns and resists overfitting")
              .otherwise("captures complex boundaries at a higher cost"))
    return out.withColumn("reason", reason)
