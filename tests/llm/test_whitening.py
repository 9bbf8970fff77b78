"""Whitening against numpy's symmetric eigensolver, its solver on hard spectra, odd tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tabsonde.llm.queries import QUERIES
from tabsonde.llm.whitening import _deviation, bidiagonal, directions, dqds, twisted, whiten

RNG = np.random.default_rng(11)
LEFT, RIGHT = np.linalg.qr(RNG.normal(size=(300, 20)))[0], np.linalg.qr(RNG.normal(size=(20, 20)))[0]


@pytest.mark.parametrize("values", [
    [5] * 4 + [3] * 4 + [1] * 12, list(10.0 ** -np.arange(20)), list(1 + 1e-9 * np.arange(20)), [4, 2, 1] + [0] * 17,
    list(np.arange(20) + 1.0), [1e8, 1e-8] * 10])
def test_directions(values):
    a = LEFT @ np.diag(values) @ RIGHT.T
    r = np.linalg.qr(a, mode="r")
    found, basis = directions(r, 20)
    want = np.sort(np.square(values))[::-1]
    assert np.allclose(found, want, rtol=1e-7, atol=1e-13 * want[0])
    assert np.abs(basis.T @ basis - np.eye(20)).max() < 1e-10
    assert np.linalg.norm(a.T @ (a @ basis) - basis * found) < 1e-12 * want[0]


def test_parts():
    r = np.linalg.qr(RNG.normal(size=(40, 12)), mode="r")
    d, e, v = bidiagonal(r)
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(v.T @ v, np.eye(12)) and np.allclose(v.T @ r.T @ r @ v, b.T @ b)
    values = dqds(d, e)
    assert np.allclose(values, np.linalg.svd(r, compute_uv=False) ** 2, rtol=1e-13)
    z = twisted(d, e, values[3])
    assert np.linalg.norm(b.T @ b @ z - values[3] * z) < 1e-12 * values[0]
    small = dqds(np.array([1.0, 1e-9, 1e-18]), np.array([1.0, 1.0]))  # high relative accuracy: exact product of values
    assert math.isclose(np.prod(small), 1e-54, rel_tol=1e-12)
    big = np.array([[3 << 55, -(1 << 57) + 12345], [5, -7]], np.int64)
    assert _deviation(big) == [None if v >= 10 ** 38 else v for v in (sum(int(x) ** 2 for x in row) for row in big)]


def check(rows, got, most=8):
    """rows: (key, vector) that remain."""
    x = np.floor(1024 * np.array([v for _, v in rows], float)).astype(np.int64) + 100_000
    n, d = x.shape
    s = [int(v) for v in x.sum(0)]
    exact = [[n * int(v) - t for v, t in zip(row, s)] for row in x]
    y = np.array(exact, float) / n
    e, vectors = np.linalg.eigh(y.T @ y / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(most, d)
    assert len(got) == k * n
    by_key = {(r["vec_id"], r["component"]): r for r in got}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for c in range(k):
        mine = np.array([by_key[key, c + 1]["whitened"] for key, _ in rows])
        want = y @ vectors[:, c] / np.sqrt(e[c])
        assert np.allclose(mine * np.sign(mine @ want), want, atol=1e-8)
        assert math.isclose(by_key[rows[0][0], c + 1]["explained"], e[c] / e.sum(), rel_tol=1e-9)
    for (key, _), row in zip(rows, exact):
        r = by_key[key, 1]
        assert r["n"] == n and r["deviation"] == sum(v * v for v in row)


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    fine = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(fine, QUERIES["op11_embedding_whitening"](spark, sf).collect())


def test_odd_rows(spark):
    """Dropped rows, another length, shifted data, columns named like results, many small partitions."""
    good = [(i, (RNG.normal(size=3) * [1, 2, 5] + 1e4).tolist()) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, math.nan, 2.0]), (103, [math.inf, 0.0, 0.0]), (104, []),
           (105, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in good + bad], "vec_id long, embedding array<double>, n int, vector int")
    check(good, whiten(frame.repartition(40)).collect())


def test_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0])], schema)
    assert whiten(one).count() == 0 and whiten(one.limit(0)).count() == 0
    assert whiten(spark.createDataFrame([(i, [1.5, 2.5]) for i in range(9)], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    flat = whiten(spark.createDataFrame([(None, [float(i), 2.0 * i]) for i in range(9)], schema)).collect()  # one direction
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-9
    assert {r["vec_id"] for r in flat} == {None}
