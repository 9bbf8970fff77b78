"""Embedding whitening from a blockwise QR, a bidiagonal form, qd singular values and twisted factorisations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsonde.llm.exchange import stored

SCALE, SHIFT = 1024.0, 100_000
FAN_IN = 16  # triangles that one task of the reduction joins
EPS = np.finfo(float).eps
LARGEST = 2.0 ** 52  # entries beyond this, scaled, are held there


# --- singular values and vectors of a small triangle, on the driver

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V, where r = U B V' by Householder reflections from both sides."""
    a = np.array(r, float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        u = x.copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            return u, 0.0
        u[0] += math.copysign(norm, x[0])
        return u, 2.0 / (u @ u)

    for k in range(n):
        u, f = reflector(a[k:, k])
        a[k:, k:] -= f * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            u, f = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= f * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= f * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling: differential quotient-difference steps with shifts.

    Each step keeps all quotients positive, so small values come out with high relative accuracy. A shift that
    makes a quotient negative is taken back and tried at a quarter, at last at nothing.
    """
    q, e = diagonal.astype(float) ** 2, above.astype(float) ** 2
    out, parts = [], []
    start = 0
    for i in range(len(q)):  # exact zeros cut the matrix
        if i == len(q) - 1 or e[i] == 0:
            parts.append((q[start:i + 1].copy(), e[start:i].copy(), 0.0))
            start = i + 1
    while parts:
        q, e, moved = parts.pop()
        while len(q):
            n = len(q)
            if n == 1:
                out.append(q[0] + moved)
                break
            if e[-1] <= EPS * EPS * (moved + q[-1]) or e[-1] < 1e-300:
                out.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            small = np.flatnonzero(e <= EPS * EPS * (moved + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = int(small[-1]) + 1
                parts.append((q[:cut], e[:cut - 1], moved))
                q, e = q[cut:], e[cut:]
                continue
            if q[0] < q[-1]:  # the small values at the end converge fastest
                q, e = q[::-1].copy(), e[::-1].copy()
            # the smallest eigenvalue of the last 2 x 2 block, less a little, as the shift
            a, b, c = q[-2] + e[-2] if n > 2 else q[-2], q[-1] + e[-1], math.sqrt(q[-2] * e[-1])
            half, mean = (a - b) / 2, (a + b) / 2
            shift = max(0.0, mean - math.hypot(half, c)) if n > 1 else 0.0
            if n == 2:
                low, high = _two(q, e)
                out += [low + moved, high + moved]
                break
            for s in (shift, shift * 0.9, shift / 4, 0.0):
                step = _dqds_step(q, e, s)
                if step is not None:
                    q, e = step
                    moved += s
                    break
    return np.sort(np.array(out))[::-1]


def _two(q: np.ndarray, e: np.ndarray) -> tuple[float, float]:
    """Squared singular values of a 2 x 2 bidiagonal, the small one by the determinant."""
    total = q[0] + q[1] + e[0]
    high = (total + math.sqrt(max((q[0] + e[0] - q[1]) ** 2 + 4 * q[1] * e[0], 0.0))) / 2
    return (q[0] / high) * q[1], high


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float):
    n = len(q)
    out_q, out_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        out_q[i] = d + e[i]
        if out_q[i] == 0:
            return None if shift else _zero_step(q, e)
        ratio = q[i + 1] / out_q[i]
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    out_q[-1] = d
    return out_q, out_e


def _zero_step(q: np.ndarray, e: np.ndarray):
    """A zero on the diagonal: one unshifted step with a tiny value in its place."""
    q = np.maximum(q, np.finfo(float).tiny / EPS)
    return _dqds_step(q, e, 0.0)


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue: factorisations from both ends meet at the row where the twisted
    pivot is smallest, and the vector grows from there by products alone."""
    q, e = diagonal ** 2, above ** 2
    n = len(q)
    tiny = np.finfo(float).tiny / EPS
    # B'B = L D L' with D = q and unit L of entries above / diagonal
    low, s = np.zeros(n), np.empty(n)  # stationary: L D L' - value = L+ D+ L+'
    up, p = np.zeros(n), np.empty(n)  # progressive: = U- D- U-'
    lower = above / np.where(diagonal[:-1] == 0, tiny, diagonal[:-1])
    s[0] = -value
    for i in range(n - 1):
        pivot = q[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        low[i] = q[i] * lower[i] / pivot
        s[i + 1] = low[i] * lower[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        ratio = q[i] / pivot
        up[i] = lower[i] * ratio
        p[i] = p[i + 1] * ratio - value
    # e[i] = q[i] * lower[i]**2 links both factorisations
    gamma = np.abs(s + p + value)
    k = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size > 0 else np.eye(n)[k]


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a triangle, falling, and its right singular vectors as columns.
    Vectors of values that lie close together are made orthogonal among each other by inverse iteration."""
    diagonal, above, v = bidiagonal(r)
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if scale == 0:
        return np.zeros(0), np.zeros((len(diagonal), 0))
    diagonal, above = diagonal / scale, above / scale
    above[np.abs(above) <= EPS * (np.abs(diagonal[:-1]) + np.abs(diagonal[1:]))] = 0.0
    n = len(diagonal)
    square = None
    cuts = [0, *(np.flatnonzero(above == 0) + 1), n]
    owned = [(x, a, b) for a, b in zip(cuts[:-1], cuts[1:]) for x in dqds(diagonal[a:b], above[a:b - 1])]
    owned = sorted(owned, key=lambda t: -t[0])[:most]
    z = np.zeros((n, len(owned)))
    for c, (value, a, b) in enumerate(owned):
        z[a:b, c] = twisted(diagonal[a:b], above[a:b - 1], value)
        near = [i for i in range(c) if owned[i][1] == a and owned[i][0] - value <= 1e-6 * owned[0][0]]
        residual = _residual(diagonal, above, z[:, c], value)
        if near or residual > 1e-12:
            if square is None:
                b_ = np.diag(diagonal) + np.diag(above, 1)
                square = b_.T @ b_
            z[:, c] = _inverse(square, value, z[:, near], z[:, c], slice(a, b))
    return np.array([value for value, _, _ in owned]) * scale * scale, v @ z


def _residual(diagonal: np.ndarray, above: np.ndarray, z: np.ndarray, value: float) -> float:
    y = diagonal * z
    y[:-1] += above * z[1:]
    w = diagonal * y
    w[1:] += above * y[:-1]
    return float(np.linalg.norm(w - value * z))


def _inverse(square: np.ndarray, value: float, others: np.ndarray, start: np.ndarray, part: slice) -> np.ndarray:
    """Inverse iteration inside a block, orthogonal to the vectors found for values close by."""
    block, others = square[part, part], others[part]
    n = len(block)
    shifted = block - (value + EPS * max(value, np.trace(block) / n)) * np.eye(n)
    x = start[part] + 1e-3 * np.cos(np.arange(n) * 1.7 + others.shape[1])
    for _ in range(4):
        for _ in range(2):
            x = x - others @ (others.T @ x)
        x /= np.linalg.norm(x)
        try:
            x = np.linalg.solve(shifted, x)
        except np.linalg.LinAlgError:
            x = np.linalg.lstsq(shifted, x, rcond=None)[0] + x
        x /= np.linalg.norm(x)
    for _ in range(2):
        x = x - others @ (others.T @ x)
    out = np.zeros(len(square))
    out[part] = x / np.linalg.norm(x)
    return out


# --- rows

def _whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with `width` finite entries, and their entries as whole numbers."""
    if not width:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    length = np.diff(offsets)
    given = ~np.array(column.is_null()) & (length == width)
    rows = np.flatnonzero(given)
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), float)
    values = flat[offsets[:-1][rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    fine = np.isfinite(values).all(1)
    return rows[fine], (np.floor(np.clip(values[fine] * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT)


def _width(rows: DataFrame, vector: str) -> int:
    """Length of most usable vectors; of equally frequent lengths the largest."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    kinds = rows.filter((F.size(vector) > 0) & ~odd).groupBy(F.size(vector).alias("width")).count()
    most = kinds.orderBy(F.desc("count"), F.desc("width")).first()
    return most["width"] if most else 0


def _moments(rows: DataFrame, vector: str, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of every dimension."""
    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            _, x = _whole(batch.column(0), width)
            n += len(x)
            # halves of 26 bits add up without overflow
            low, high = (x & ((1 << 26) - 1)).sum(0), (x >> 26).sum(0)
            total = [t + int(a) + (int(b) << 26) for t, a, b in zip(total, low, high)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(range(-1, width)), pa.int32()), pa.array([str(n), *map(str, total)])], names=["place", "value"])

    sums = (rows.select(vector).mapInArrow(run, "place int, value string").groupBy("place")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())  # one row per dimension
    by_place = {r["place"]: int(r["value"]) for r in sums}
    return by_place.get(-1, 0), [by_place.get(i, 0) for i in range(width)]


def _centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - S / n as doubles, each from the exact n * x - S, and those as doubles or, beyond 2**62, Python integers."""
    biggest = max((abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * n + max(map(abs, total), default=0)
    if biggest < 1 << 62:
        exact = x * n - np.array(total, np.int64)
        return exact / n, exact
    exact = x.astype(object) * n - np.array(total, object)
    return np.array([[float(v) / n for v in row] for row in exact]).reshape(x.shape), exact


def _deviation(exact: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; null from 39 digits on."""
    if exact.dtype == object:
        out = [sum(int(v) * int(v) for v in row) for row in exact]
    elif int(np.abs(exact).max(initial=0)) ** 2 * max(exact.shape[1], 1) < 1 << 62:
        return (exact * exact).sum(1).tolist()
    else:  # three digits of 21 bits
        a, b, c = exact >> 42, (exact >> 21) & ((1 << 21) - 1), exact & ((1 << 21) - 1)
        sums = [(x * y).sum(1).tolist() for x, y in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))]
        out = [(aa << 84) + (ab << 64) + (ac << 43) + (bb << 42) + (bc << 22) + cc for aa, ab, ac, bb, bc, cc in zip(*sums)]
    return [v if v < 10 ** 38 else None for v in out]


def _triangle(rows: DataFrame, vector: str, width: int, n: int, total: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows: each task folds its blocks into one triangle; triangles are
    joined FAN_IN at a time until one is left, so no task holds more than that many."""
    upper = np.triu_indices(width)

    def folded(blocks) -> np.ndarray:
        r = np.zeros((0, width))
        for b in blocks:
            r = np.linalg.qr(np.vstack([r, b]), mode="r")
        out = np.zeros((width, width))
        out[:len(r)] = r
        return out

    def unpacked(b: bytes) -> np.ndarray:
        out = np.zeros((width, width))
        out[upper] = np.frombuffer(b)
        return out

    def blocks_of(batches):
        for batch in batches:
            _, x = _whole(batch.column(0), width)
            for i in range(0, len(x), 4 * width + 1024):
                yield _centred(x[i:i + 4 * width + 1024], n, total)[0]

    def leaf(batches):
        yield pa.RecordBatch.from_arrays([pa.array([folded(blocks_of(batches))[upper].tobytes()], pa.binary())],
                                         names=["r"])

    def join(batches):
        r = folded(unpacked(v.as_py()) for b in batches for v in b.column("r"))
        yield pa.RecordBatch.from_arrays([pa.array([r[upper].tobytes()], pa.binary())], names=["r"])

    level = stored(rows.select(vector).mapInArrow(leaf, "r binary"), "triangles")
    while (count := level.count()) > 1:
        parts = -(-count // FAN_IN)
        level = stored(level.repartition(parts).mapInArrow(join, "r binary"), "triangles")
    row = level.first()
    return unpacked(bytes(row["r"])) if row else np.zeros((width, width))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 8) -> DataFrame:
    """Coordinates of every row along its table's leading principal directions, scaled to unit variance.

    An entry c counts as the whole number x = floor(1024 * c) + 100000. Covariances have divisor n and are never
    formed: rows are centred exactly, n * x - S in whole numbers, before anything is multiplied.

    1. One pass for n and the sums S. 2. Blockwise QR of the centred rows to one triangle R, whose size depends on
    the dimensions only. 3. On the driver R becomes bidiagonal by Householder reflections, dqds finds the squared
    singular values, twisted factorisations their vectors. 4. One pass for the covariance of the coordinates, one
    for the rows.

    Returns for each row and component (from 1, by falling variance): the key, component int, n long, deviation
    decimal(38,0) (exact sum over dimensions of (n * x - S)**2; null beyond), whitened double, explained double (the
    component's share of the total variance), identity_error double (largest absolute entry of the whitened
    covariance less the identity, one value for all).

    Rows whose vector is null, empty, or holds a null, infinite or undefined entry are dropped, and so are those
    of another length than most rows have (the longer one, if two are equally frequent). Entries above 2**42 in
    size count as that. Directions without variance have no unit variance and are left out: equal rows, or a
    single one, give no row. A null key stays, repeated rows are rows, other columns are not read. Each
    component's largest coefficient is positive.
    """
    kept = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    width = _width(kept, "vector")
    n, total = _moments(kept, "vector", width) if width else (0, [])
    values, basis = np.zeros(0), np.zeros((width, 0))
    trace = 0.0
    if n > 1:
        r = _triangle(kept, "vector", width, n, total)
        values, basis = directions(r, most)
        trace = float((r * r).sum())
        alive = values > max(n, width) * EPS * EPS * (values[0] if len(values) else 0) * 1e4
        values, basis = values[alive], basis[:, alive]
        flip = np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
        basis = basis * flip
    found = len(values)
    spread = np.sqrt(values / max(n, 1))
    project = basis / spread if found else basis

    def coordinates(batch: pa.RecordBatch, place: int):
        at, x = _whole(batch.column(place), width)
        centred, exact = _centred(x, n, total)
        return at, centred @ project, exact

    def gram(batches):
        one, two, seen = np.zeros(found), np.zeros((found, found)), False
        for batch in batches:
            _, w, _ = coordinates(batch, 0)
            one, two, seen = one + w.sum(0), two + w.T @ w, True
        if seen:
            flat = np.concatenate([one, two.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"])

    error = 0.0
    if found:
        sums = {r["place"]: r["value"] for r in kept.select("vector").mapInArrow(gram, "place long, value double")
                .groupBy("place").agg(F.sum("value").alias("value")).collect()}  # most + most**2 rows
        mean = np.array([sums[i] for i in range(found)]) / n
        square = np.array([sums[found + i] for i in range(found * found)]).reshape(found, found) / n
        error = float(np.abs(square - np.outer(mean, mean) - np.eye(found)).max())
    share = values / trace if trace else values

    def out(batches):
        for batch in batches:
            at, w, exact = coordinates(batch, 1)
            if not len(at) or not found:
                continue
            size = len(at) * found
            deviation = np.repeat(np.array(_deviation(exact), object), found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(at, found))),
                 pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(at))), pa.array(np.full(size, n)),
                 pa.array(deviation, pa.decimal128(38, 0)), pa.array(w.ravel()),
                 pa.array(np.tile(share, len(at))), pa.array(np.full(size, error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = T.StructType([T.StructField("key", kept.schema["key"].dataType), *T._parse_datatype_string(
        "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    return kept.mapInArrow(out, schema).withColumnRenamed("key", key)
