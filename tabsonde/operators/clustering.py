"""K-means, principal components and isolation forest on standardised numeric columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType

from tabsonde.plans.parallel import widen
from tabsonde.plans.quantiles import column_quantiles
from tabsonde.plans.storage import Scratch
from tabsonde.schema import as_double, numeric_columns, require_numeric

TREES, SUBSAMPLE = 100, 256
EULER = 0.5772156649015329


def standardised(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with a scaled `features` vector, next to the kept columns."""
    require_numeric(df, features)
    rows = df.select(*keep, *[as_double(c).alias(c) for c in features if c not in keep]).na.drop(subset=list(features))
    assembled = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(rows)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(assembled)
    return widen(scaler.transform(assembled).drop("_raw"))


ROUNDS, STEPS, SETTLED = 5, 30, 1e-4


class Scaled:
    """Complete rows of some columns and their means and standard deviations, from one pass (constants count as 1)."""

    def __init__(self, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()):
        require_numeric(df, features)
        self.features, self.keep = list(features), [c for c in keep if c not in features]
        values = [as_double(c).alias(c) for c in features]
        self.rows = widen(df.select(*self.keep, *values).na.drop(subset=self.features))
        row = self.rows.agg(F.count(F.lit(1)), *[f(c) for c in self.features for f in (F.avg, F.stddev_samp)]).first()
        self.n = row[0]
        self.mean = np.array([v or 0.0 for v in row[1::2]], float)
        self.std = np.array([v or 1.0 for v in row[2::2]], float)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in self.features], 1).astype(float)
            yield batch, (x - self.mean) / self.std

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # tasks need the numbers only


def _distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (the first of equals) and squared distance of each row."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near]


def _fractions(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row, from the bits of its values and the salt alone."""
    h = np.full(len(x), 0x9E3779B97F4A7C15 * (salt + 1) % (1 << 64), np.uint64)
    for column in np.ascontiguousarray(x + 0.0).view(np.uint64).T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(float) / 2.0 ** 53


def _sums(scaled: Scaled, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sums of values, sums of squared lengths and of squared distances) of every centre's rows."""
    k, p = centres.shape

    def part(batches):
        total = np.zeros((k, p + 3))
        for _, x in scaled.batches(batches):
            near, d = _distances(x, centres)
            for j, v in enumerate((np.ones(len(x)), *x.T, (x * x).sum(1), d)):
                total[:, j] += np.bincount(near, v, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), p + 3)), pa.array(np.tile(np.arange(p + 3), k)),
                                          pa.array(total.ravel())], names=["c", "j", "v"])

    out = np.zeros((k, p + 3))
    rows = scaled.rows.select(*scaled.features).mapInArrow(part, "c bigint, j bigint, v double")
    for r in rows.groupBy("c", "j").agg(F.sum("v").alias("v")).collect():  # k * (features + 3) numbers
        out[r["c"], r["j"]] = r["v"]
    return out[:, 0], out[:, 1:-2], out[:, -2:]


def seeds(scaled: Scaled, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """First centres: some 2 k candidates a round, each row drawn with a chance that grows with its distance from the
    candidates so far; of all candidates k are chosen in the same manner, weighted by the rows next to them.

    Draws come from the values themselves, so neither partitions nor the order of rows matter. Candidates are few
    whatever the table's size: they are what the driver sees.
    """
    def drawn(centres: np.ndarray | None, total: float, salt: int) -> np.ndarray:
        def pick(batches):
            best = None
            for _, x in scaled.batches(batches):
                u = _fractions(x, salt)
                if centres is None:  # the row of the least fraction; equal fractions belong to equal rows
                    i = int(u.argmin())
                    if best is None or u[i] < best[0]:
                        best = (u[i], x[i])
                else:
                    hit = np.flatnonzero(u * total < 2 * k * _distances(x, centres)[1])
                    if len(hit):
                        x = np.unique(x[hit], axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(np.zeros(len(x)))], names=["x", "u"])
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[1].tolist()], pa.list_(pa.float64())), pa.array([best[0]])], names=["x", "u"])
        rows = scaled.rows.select(*scaled.features).mapInArrow(pick, "x array<double>, u double")
        rows = rows.orderBy("u", "x").limit(1) if centres is None else rows.select("x").distinct()
        return np.array(sorted(tuple(r["x"]) for r in rows.collect()), float).reshape(-1, len(scaled.features))

    found = drawn(None, 0.0, 0)
    if not len(found):
        return found
    for i in range(rounds):
        total = float(_sums(scaled, found)[2][:, 1].sum())
        if total <= 0:
            break
        found = np.unique(np.vstack([found, drawn(found, total, i + 1)]), axis=0)
    weight = _sums(scaled, found)[0]
    chosen = [int(weight.argmax())]
    rng = np.random.default_rng(42)
    while len(chosen) < min(k, len(found)):
        d = weight * _distances(found, found[chosen])[1]
        if d.sum() <= 0:
            break
        chosen.append(int(np.searchsorted(np.cumsum(d), rng.random() * d.sum(), "right").clip(0, len(found) - 1)))
    return found[chosen]


def kmeans_centres(scaled: Scaled, k: int) -> tuple[np.ndarray, float]:
    """(centres in scaled units in ascending order, sum of squared distances). Fewer than k distinct rows give fewer."""
    centres = seeds(scaled, k)
    if not len(centres):
        return centres, 0.0
    for _ in range(STEPS):
        n, sums, _ = _sums(scaled, centres)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        step = float(((moved - centres) ** 2).sum(1).max())
        centres = moved
        if step <= SETTLED ** 2:
            break
    centres = centres[np.lexsort(centres.T[::-1])]
    return centres, float(_sums(scaled, centres)[2][:, 1].sum())


def assign(scaled: Scaled, centres: np.ndarray) -> DataFrame:
    """The rows with their `cluster`, the nearest of the centres (in scaled units), the first of equals."""
    names = [*scaled.keep, *scaled.features]

    def run(batches):
        for batch, x in scaled.batches(batches):
            near = _distances(x, centres)[0] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*names, "cluster"])

    rows = scaled.rows.select(*names)
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("cluster", T.IntegerType())]))


def kmeans_assign(df: DataFrame, features: Sequence[str], k: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, features, cluster): complete rows with their cluster; clusters ascend by centre."""
    scaled = Scaled(df, features, keep)
    return assign(scaled, kmeans_centres(scaled, k)[0])


def _silhouette(scaled: Scaled, centres: np.ndarray) -> float | None:
    """Mean over rows of (b - a) / max(a, b), a and b the mean squared distances to the own and the nearest other
    cluster, from the clusters' sums."""
    n, sums, more = _sums(scaled, centres)
    if (n > 0).sum() < 2:
        return None

    def part(batches):
        total = 0.0
        for _, x in scaled.batches(batches):
            near = _distances(x, centres)[0]
            mean = np.where(n > 0, ((x * x).sum(1)[:, None] + more[:, 0] / np.maximum(n, 1) - 2 * x @ (sums / np.maximum(n, 1)[:, None]).T), np.inf)
            at = np.arange(len(x))
            own = mean[at, near] * n[near] / np.maximum(n[near] - 1, 1)
            mean[at, near] = np.inf
            other = mean.min(1)
            top = np.maximum(own, other)
            total += float(np.where((n[near] > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1.0), 0.0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    return scaled.rows.select(*scaled.features).mapInArrow(part, "v double").agg(F.sum("v")).first()[0] / scaled.n


def cluster_profile(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cluster, size, column_name, mean) of rows with their cluster."""
    means = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in features])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mean")) for c in features]))
    return means.select("cluster", "size", cells.alias("c")).select("cluster", "size", "c.*")


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """(cluster, size, column_name, mean, inertia, silhouette).

    The mean of a column in a cluster is its centre in original units; clusters ascend by centre. The silhouette uses
    squared Euclidean distance, which can be summed without comparing all pairs of rows. Results do not depend on how
    the rows are spread. A pass of sums is one job over the table; nothing is cached.
    """
    scaled = Scaled(df, features)
    centres, cost = kmeans_centres(scaled, k)
    silhouette = _silhouette(scaled, centres) if k > 1 and len(centres) else None
    return cluster_profile(assign(scaled, centres), features).select(
        "*", F.lit(float(cost)).alias("inertia"), F.lit(silhouette).cast("double").alias("silhouette"))


def principal_components(df: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """(component, explained_variance, column_name, loading)."""
    model = PCA(k=min(k, len(features)), inputCol="features", outputCol="pc").fit(standardised(df, features))
    loadings = model.pc.toArray()  # features x components
    rows = [(j + 1, float(model.explainedVariance[j]), c, float(loadings[i, j]))
            for j in range(loadings.shape[1]) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(
        rows, "component int, explained_variance double, column_name string, loading double")


def project(df: DataFrame, features: Sequence[str], keep: Sequence[str], k: int = 3) -> DataFrame:
    """(keep, pc_1 .. pc_k): every complete row on the leading components."""
    rows = standardised(df, features, keep)
    model = PCA(k=min(k, len(features)), inputCol="features", outputCol="_pc").fit(rows)
    arr = vector_to_array("_pc")
    return model.transform(rows).select(*keep, *[arr[i].alias(f"pc_{i + 1}") for i in range(min(k, len(features)))])


# ---- isolation forest ------------------------------------------------------------------

def _average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(features: Sequence[str]):
    """Grow one tree from its subsample; nodes as (tree, node, left, right, feature, cut, depth)."""
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_k")[list(features)].to_numpy(float)
        rng = np.random.default_rng(42 + tree)
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes: list[list] = []

        def add(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([tree, me, -1, -1, -1, 0.0, depth + _average_path(len(rows))])
            spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
            if depth < limit and len(rows) > 1 and spread.max() > 0:
                f = int(rng.choice(np.flatnonzero(spread > 0)))
                low, high = x[rows, f].min(), x[rows, f].max()
                cut = rng.uniform(low, high)
                left = x[rows, f] < cut
                a, b = add(rows[left], depth + 1), add(rows[~left], depth + 1)
                nodes[me][2:6] = [a, b, f, cut]
            return me

        add(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "l", "r", "feature", "cut", "path"])
    return grow


def grow_forest(df: DataFrame, features: Sequence[str], trees: int = TREES, subsample: int = SUBSAMPLE,
                key: Sequence[str] = ()) -> pd.DataFrame:
    """All nodes of the forest: at most trees * 2 * subsample rows, so they fit on the driver.

    Each tree's rows come from the whole table, in one pass: every row makes a few draws by a hash of its key (of
    its features without one), and a draw that hits sends the row to one tree. Twice the rows needed are expected
    per tree; of those the `subsample` with the least hash are taken. So the forest depends on the rows alone, not
    on how they are spread. The trees are grown in parallel.
    """
    total = df.count()
    draws = max(1, math.ceil(2.0 * subsample * trees / max(total, 1)))
    share = 2.0 * subsample * trees / max(total, 1) / draws
    big = F.lit(1 << 52)
    hashed = F.pmod(F.xxhash64(F.lit(42), "_draw", *(key or features)), big)
    picked = (df.select(*dict.fromkeys([*key, *features]), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
              .withColumn("_u", hashed / big).where(F.col("_u") < share)
              .withColumn("tree", F.floor(F.col("_u") / share * trees).cast("int")))
    order = [F.xxhash64(F.lit(43), "tree", *(key or features)), *(key or features), "_draw"]
    pick = Window.partitionBy("tree").orderBy(*order)
    chosen = picked.withColumn("_k", F.row_number().over(pick)).where(F.col("_k") <= subsample).select("tree", "_k", *features)
    return chosen.groupBy("tree").applyInPandas(
        _grow(features), "tree int, node int, l int, r int, feature int, cut double, path double").toPandas()


def _walkable(tree: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(left, right, feature, cut, path) where a leaf leads to itself, so that all rows can take
    the same number of steps."""
    left, right = tree["l"].to_numpy(np.int32), tree["r"].to_numpy(np.int32)
    own = tree["node"].to_numpy(np.int32)
    leaf = left < 0
    return (np.where(leaf, own, left), np.where(leaf, own, right), np.maximum(tree["feature"].to_numpy(np.int64), 0),
            tree["cut"].to_numpy(float), tree["path"].to_numpy(float))


def isolation_scores(df: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with `score` in (0, 1): near 1 isolated, near 0.5 ordinary.

    Splits are drawn between the minimum and maximum of a node, so scaling the columns first
    would not change the trees.
    """
    features = list(features or numeric_columns(df))
    require_numeric(df, features)
    rows = df.select(*keep, *[as_double(c).alias(c) for c in features if c not in keep]).na.drop(subset=features)
    nodes = grow_forest(rows, features, key=[c for c in keep if c in rows.columns])
    rows = widen(rows)
    forest = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    arrays = [_walkable(g) for g in forest]
    depth = math.ceil(math.log2(SUBSAMPLE))
    shared = df.sparkSession.sparkContext.broadcast(arrays)

    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        flat, at = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for left, right, feature, cut, path in shared.value:
            node = np.zeros(len(x), dtype=np.int32)
            for _ in range(depth):
                value = flat[at + feature[node]]
                node = np.where(value < cut[node], left[node], right[node])
            total += path[node]
        return pd.Series(2.0 ** (-total / len(shared.value) / _average_path(SUBSAMPLE)))

    udf = F.pandas_udf(score, DoubleType())
    return rows.withColumn("score", udf(*[F.col(c) for c in features]))


def anomalies(df: DataFrame, features: Sequence[str] | None = None, contamination: float = 0.1,
              keep: Sequence[str] = ()) -> DataFrame:
    """Every complete row with its score and whether it is among the `contamination` share
    with the highest scores."""
    # Scored once: the threshold takes several passes and the result reads the same rows.
    scored = Scratch(df.sparkSession).keep(isolation_scores(df, features, keep), "scored")
    limit = column_quantiles(scored.select("score"), ["score"], [1 - contamination])["score", 1 - contamination]
    return scored.withColumn("is_anomaly", F.col("score") > F.lit(limit))


def anomaly_summary(df: DataFrame, features: Sequence[str] | None = None, contamination: float = 0.1) -> DataFrame:
    """(column_name, n, ratio, mean, std, min, max) of the anomalous rows per column."""
    features = list(features or numeric_columns(df))
    rows = anomalies(df, features, contamination)
    hit = F.col("is_anomaly")
    aggs = [F.count_if(hit).alias("n"), F.avg(hit.cast("double")).alias("ratio")]
    for i, c in enumerate(features):
        v = F.when(hit, F.col(c))
        aggs += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                      F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, c in enumerate(features)]
    return rows.agg(*aggs).select("n", "ratio", F.explode(F.array(*cells)).alias("c")).select("n", "ratio", "c.*")
