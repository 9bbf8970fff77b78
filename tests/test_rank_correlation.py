"""Kendall and Spearman against brute force, for groups held in one task and for groups spread over ranges."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsonde.functions import ranks
from tabsonde.operators import correlation


def brute_s(x, y, n):
    sign = np.sign(np.subtract.outer(x, x) * np.subtract.outer(y, y)) * np.outer(n, n)
    return sign.sum() / 2


def brute(points):
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    m = len(points)
    tied = [m * (m - 1) / 2 - sum(t * (t - 1) / 2 for t in np.unique(v, return_counts=True)[1]) for v in (x, y)]
    tau = brute_s(x, y, np.ones(m)) / math.sqrt(tied[0] * tied[1]) if min(tied) > 0 else None

    def rank(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    u, v = rank(x), rank(y)
    rho = np.corrcoef(u, v)[0, 1] if u.std() and v.std() else None
    return tau, rho


@pytest.mark.parametrize("values", [2, 7, 40, 3000])
def test_signs_in_pieces(values):
    """The running vectors give the same sum whole and cut anywhere."""
    rng = np.random.default_rng(values)
    x, y, n = rng.integers(0, values, 500), rng.integers(0, values, 500), rng.integers(1, 5, 500)
    pairs = np.unique(np.stack([x, y], 1), axis=0)
    n = n[:len(pairs)]
    x, y = pairs.T
    want = brute_s(x, y, n)
    assert ranks.kendall_sum(x, y, n) == want
    rank = np.unique(y, return_inverse=True)[1]
    total = 0.0
    for level in range(ranks.levels(rank.max())):
        block, digit = rank >> 5 * (level + 1), (rank >> 5 * level) & 31
        order = np.lexsort((x, block))
        b, v, d, w = block[order], x[order], digit[order], n[order]
        before = held = None
        at = 0
        while at < len(b):
            to = min(len(b), at + int(rng.integers(1, 9)))
            if at and b[at] != b[at - 1]:
                before = held = None
            elif at and v[at] != v[at - 1]:
                held = None
            s, before, held = ranks.signs(b[at:to], v[at:to], d[at:to], w[at:to], before, held)
            total, at = total + s, to
    assert total == want


@pytest.mark.parametrize("together", [1 << 19, 60, 0])
def test_groups(spark, monkeypatch, together):
    """Keys with few and many values, a null key, a hot value, a constant and missing values."""
    monkeypatch.setattr(correlation, "TOGETHER", together)
    rnd = random.Random(3)
    rows = {k: [(float(rnd.randrange(vx)), float(rnd.randrange(vy)) + (0.5 if hot and rnd.random() < 0.5 else 0)) for _ in range(m)]
            for k, m, vx, vy, hot in (("a", 400, 1000, 1000, 0), ("b", 300, 3, 200, 1), (None, 200, 50, 1, 1), ("d", 150, 1, 90, 0), ("e", 2, 9, 9, 0))}
    rows["b"] += [(1.0, 0.0)] * 200
    frame = spark.createDataFrame([(k, x, y) for k, v in rows.items() for x, y in v] + [("a", None, 1.0), ("e", 2.0, float("nan"))],
                                  "k string, x double, y double").repartition(6)
    for method, place in (("kendall", 0), ("spearman", 1)):
        got = {r.k: r for r in correlation.correlation_test(frame, "x", "y", method, ["k"]).collect()}
        assert set(got) == set(rows)
        for k, v in rows.items():
            want = brute(v)[place]
            assert got[k].n == len(v)
            assert (got[k].correlation is None) == (want is None), k
            if want is not None:
                assert got[k].correlation == pytest.approx(want, abs=1e-9)
    one = correlation.correlation_test(frame.where("k = 'a'"), "x", "y", "kendall").first()
    assert one.correlation == pytest.approx(brute(rows["a"])[0], abs=1e-9)


def test_empty(spark):
    frame = spark.createDataFrame([], "k string, x double, y double")
    for method in ("kendall", "spearman"):
        assert correlation.correlation_test(frame, "x", "y", method, ["k"]).count() == 0
        assert correlation.correlation_test(frame, "x", "y", method).where("correlation IS NOT NULL").count() == 0


def test_rows_per_point():
    assert ranks.levels(2 ** 35 - 1) == 7 and ranks.levels(0) == 1 and ranks.levels(32) == 2


def test_matrix_of_complete_columns(spark, monkeypatch):
    """Columns without missing values are ranked once: no pair of values is counted for them. Any mix of columns with
    few and many values, with and without missing ones, gives what single pairs give."""
    df = spark.range(3000).select(
        (F.xxhash64("id") % 1000).cast("double").alias("many"), (F.xxhash64("id", F.lit(1)) % 700 + F.col("id") % 5).alias("more"),
        (F.col("id") % 5).alias("few"), (F.xxhash64("id", F.lit(2)) % 3).alias("three"), F.lit(1).alias("one"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("gaps"))
    cols = df.columns
    want = {(a, b): correlation.correlation_test(df, a, b, "spearman").first() for a, b in [("many", "more"), ("many", "few"), ("few", "three"), ("more", "gaps"), ("few", "one")]}
    stacked = correlation._long_pairs
    asked = []
    monkeypatch.setattr(correlation, "_long_pairs", lambda df, pairs: asked.append(list(pairs)) or stacked(df, pairs))
    for bound in (1 << 16, 100):
        monkeypatch.setattr(correlation, "FEW_VALUES", bound)
        got = {(r.column_1, r.column_2): r for r in correlation.rank_correlation_matrix(df, cols).collect()}
        assert len(got) == 15
        for k, w in want.items():
            assert got[k].n == w.n and got[k].r == (pytest.approx(w.correlation, abs=1e-12) if w.correlation is not None else None)
    assert [len(p) for p in asked] == [5, 6]  # with gaps; also the pair of two columns with many values
    assert correlation.rank_correlation_matrix(df.limit(0), cols).count() == 0
