"""Texts as flat byte arrays: words, hashes of words and of word or byte windows.

A chunk is the UTF-8 bytes of some texts, one after another, with their offsets. White space is ASCII
0x20 and 0x09-0x0D everywhere; all other bytes belong to words. Hashes are polynomials modulo the prime 2**61 - 1,
so a window's hash is a difference of running sums. (Modulo a power of two some
sequences, such as those of Thue and Morse, would collide for every base.)
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once
BASE = [0x1E3779B97F4A7C15, 0x11342543DE82EF95]
WINDOW_BASE = [0x1F58476D1CE4E5B9, 0x14D049BB133111EB]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def kept_by_worker(kind: type, path: str):
    """kind(path), kept by this Python worker from task to task; of such objects only the last one used."""
    have = getattr(sys, "_tabsonde_kept", None)
    if have is None or type(have).__name__ != kind.__name__ or have.path != path:
        sys._tabsonde_kept = None  # free the last one first
        have = sys._tabsonde_kept = kind(path)
    return have


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system. A chunk's arrays, freed, otherwise stay with the worker from task to task:
    glibc keeps all that lies below the last block in use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `size` bytes, one row at least. After
    the last one the worker gives freed memory back."""
    data, offsets = flat(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last
    give_back()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                p[filled:2 * filled] = p[:filled] * np.uint64(pow(b, filled, 1 << 64))
                filled *= 2
            out.append(p)
        _powers[base] = have = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


PRIME = np.uint64((1 << 61) - 1)
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _u(n: int) -> np.uint64:
    return np.uint64(n)


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & PRIME) + (x >> _u(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, from halves of 30 and 31 bits."""
    a_high, a_low, b_high, b_low = a >> _u(31), a & _LOW31, b >> _u(31), b & _LOW31
    middle = a_high * b_low + a_low * b_high
    # 2**62 is 2, and 2**31 times the upper part of the middle is that part itself, twice shifted
    return _reduced(_reduced((a_high * b_high << _u(1)) + (middle >> _u(30)) + ((middle & _LOW30) << _u(31)))
                    + a_low * b_low)


def prime_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i below n at least."""
    have = _prime_powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, int(PRIME))):
            p = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                p[filled:2 * filled] = times(p[:filled], np.uint64(pow(b, filled, int(PRIME))))
                filled *= 2
            out.append(p)
        _prime_powers[base] = have = (out[0], out[1])
    return have


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of value * base**i before each i, modulo PRIME each; one longer than values. The sums are kept in two
    rows, with factors 1 and 2**31, that do not overflow. Bytes count one more than they are."""
    n = len(values)
    power = prime_powers(base, n + 1)[0][:n]
    out = np.zeros((2, n + 1), np.uint64)
    if values.dtype == np.uint8 and n < 1 << 23:
        few = values + np.uint64(1)
        low, high = few * (power & _LOW31), few * (power >> _u(31))  # below 2**40
    else:
        terms = times(_reduced(values.astype(np.uint64) + _u(values.dtype == np.uint8)), power)
        low, high = terms & _LOW31, terms >> _u(31)
    np.cumsum(low, out=out[0, 1:])
    np.cumsum(high, out=out[1, 1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the values from start to end, equal for equal sequences of values of equal length."""
    low, high = (_reduced(s[end] - s[start]) for s in sums)
    whole = _reduced(low + times(high, np.uint64(1 << 31)))
    return mix(times(whole, prime_powers(base, sums.shape[1])[1][start]))


class Words:
    """Words of a chunk: byte spans, the row of each word, and the words before each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[1:] = ~solid[:-1]
        before[:1] = True
        self.start = np.flatnonzero(solid & (before | edge[:n]))
        after = np.empty(n, bool)
        after[:-1] = ~solid[1:]
        after[-1:] = True
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # word at which each row starts
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, lane: int = 0) -> np.ndarray:
        sums = running(self.data, BASE[lane])
        length = (self.end - self.start).astype(np.uint64)
        return mix(between(sums, self.start, self.end, BASE[lane]) + length)

    def windows(self, size: int, values: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of `size` words that stay within a row, and the windows' hashes."""
        starts = self.window_starts(size)
        return starts, window_hashes(values, starts, size, lane)

    def window_starts(self, size: int) -> np.ndarray:
        room = self.first[self.row + 1] - np.arange(len(self.row))
        return np.flatnonzero(room >= size)


def window_hashes(values: np.ndarray, starts: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    return between(running(values, WINDOW_BASE[lane]), starts, starts + size, WINDOW_BASE[lane])


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in [start, start + size) of any start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:n]) > 0


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] values), then the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before - first, count)
