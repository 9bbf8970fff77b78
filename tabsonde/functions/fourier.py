"""Parts of a discrete Fourier transform of any length that is too long for one task.

A transform of length n becomes a convolution by the chirp exp(-pi i j^2 / n), whose length is a power of two; that is
transformed in four steps as a matrix of `columns` x `rows`: along one side, twiddle factors, along the other side.
"""

from __future__ import annotations

import numpy as np


def power_of_two(n: int) -> int:
    """Length of the convolution that gives n values."""
    return 1 << max(2, int(2 * n - 2).bit_length())


def sides(length: int) -> tuple[int, int]:
    """(columns, rows): both powers of two, about equal."""
    bits = length.bit_length() - 1
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i j^2 / n); j^2 is taken modulo 2n before it becomes an angle."""
    j = j.astype(np.int64)
    square = j * j % (2 * n) if n < 1 << 31 else np.array([int(v) ** 2 % (2 * n) for v in j], float)
    return np.exp(-1j * np.pi * square / n)


def first_side(matrix: np.ndarray, j2: np.ndarray, length: int) -> np.ndarray:
    """Transform along the columns' side (rows of `matrix` are positions j2), times the twiddle factors."""
    out = np.fft.fft(matrix, axis=1)
    return out * np.exp(-2j * np.pi * ((j2[:, None] * np.arange(out.shape[1])) % length) / length)


def strongest(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, powers) of the strongest positive frequencies of the mean-free values; ties: the lower first."""
    n = len(values)
    power = np.abs(np.fft.rfft(values - values.mean()))[1:n // 2 + 1] ** 2
    best = np.lexsort((np.arange(len(power)), -power))[:top]
    return best + 1, power[best]
