"""K-means: independent of partitions, planted clusters, SQL-like assignment, odd tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsonde.operators import clustering


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    at = np.repeat([[0, 0], [8, 1], [3, 9], [-6, 5]], 300, axis=0)
    x = at + rng.normal(size=at.shape)
    pdf = pd.DataFrame({"i": range(len(x)), "truth": np.repeat(np.arange(4), 300), "a": x[:, 0] * 1000, "b": x[:, 1]})
    return spark.createDataFrame(pdf).cache()


def test_partitions_do_not_matter(blobs):
    one, seven = (clustering.kmeans(blobs.repartition(n), ["a", "b"], 4).orderBy("cluster", "column_name").collect() for n in (1, 7))
    assert len(one) == len(seven) == 8
    for r, s in zip(one, seven):
        assert (r.cluster, r.size, r.column_name) == (s.cluster, s.size, s.column_name)
        assert (r.mean, r.inertia, r.silhouette) == pytest.approx((s.mean, s.inertia, s.silhouette), rel=1e-9)


def test_planted_clusters(blobs):
    got = clustering.kmeans_assign(blobs, ["a", "b"], 4, ["i", "truth"])
    top = got.groupBy("truth", "cluster").count().groupBy("truth").agg(F.max("count").alias("n")).collect()
    assert len(top) == 4 and min(r.n for r in top) > 290
    r = clustering.kmeans(blobs, ["a", "b"], 4).first()
    x = got.toPandas()
    z = (x[["a", "b"]] - x[["a", "b"]].mean()) / x[["a", "b"]].std()
    centre = z.groupby(x.cluster).transform("mean")
    assert r.inertia == pytest.approx(((z - centre) ** 2).to_numpy().sum(), rel=1e-6)
    d = ((z.to_numpy()[:, None] - z.to_numpy()[None]) ** 2).sum(2)
    sizes = x.cluster.value_counts()
    mean = np.stack([d[:, x.cluster == c].sum(1) / (sizes[c] - (x.cluster == c)) for c in range(4)], 1)
    own = mean[np.arange(len(x)), x.cluster]
    mean[np.arange(len(x)), x.cluster] = np.inf
    other = mean.min(1)
    assert r.silhouette == pytest.approx(((other - own) / np.maximum(own, other)).mean(), rel=1e-6)


def test_odd_tables(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 5 + [(None, 3.0)], "a double, b double")
    got = clustering.kmeans(same, ["a", "b"], 3).collect()
    assert {(r.cluster, r.size, r.inertia) for r in got} == {(0, 5, 0.0)} and got[0].silhouette is None
    assert clustering.kmeans(same.limit(0), ["a", "b"], 3).count() == 0
    few = spark.createDataFrame([(float(i),) for i in (1, 1, 2)], "a double")
    assert sorted(r.size for r in clustering.kmeans(few, ["a"], 3).collect()) == [1, 2]
