"""Vectorised text kernels: word boundaries, word hashes and shingle hashes of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes other than letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: Of the powers a worker keeps only so many first ones; all others are products of two, made anew.
KEPT_POWERS = 1 << 12


@functools.lru_cache(maxsize=16)
def _kept(base: int) -> np.ndarray:
    out = np.full(KEPT_POWERS, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    blocks = np.full(-(-n // KEPT_POWERS), pow(base, KEPT_POWERS, 1 << 64), U)
    blocks[:1] = 1
    return np.multiply.outer(np.cumprod(blocks, dtype=U), _kept(base)).ravel()[:n]


class Rolling:
    """Polynomial hashes modulo 2^64 of any byte range of ``data``: one prefix sum, then O(1) for each range."""

    def __init__(self, data: np.ndarray, fold_case: bool = False, seed: int = 7):
        table = _seeded(256, seed)
        if fold_case:
            table = table[_LOWER]
        base = int(_seeded(1, seed + 1)[0]) | 1
        self.inverse = pow(base, -1, 1 << 64)
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(table[data] * powers(n, base), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = int(starts.max()) + 1 if len(starts) else 0
        return mix((self.sums[ends] - self.sums[starts]) * powers(n, self.inverse)[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes outside ``gaps`` (white space); runs never cross rows."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word with A-Z in lower case, and its row."""
    starts, ends, rows = words(data, offsets, gaps)
    return Rolling(data, True).of(starts, ends), rows


def word_offsets(rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the index of its first word, and the number of words at the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``size``-word shingle in order; a row with fewer words gives its whole sequence."""
    at = word_offsets(rows, n)
    count = np.diff(at)
    out = np.zeros(len(hashes), U)
    with np.errstate(over="ignore"):
        for k in range(size):
            m = max(0, len(hashes) - k)
            out[:m] = mix(out[:m] * U(3) + hashes[k:] + U(k + 1))
        place = np.arange(len(hashes)) - at[rows]
        whole = place + size <= count[rows]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            for r in short:
                h = U(0)
                for k in range(at[r], at[r + 1]):
                    h = mix(np.array([h * U(3) + hashes[k] + U(1000 + k - at[r])], U))[0]
                out[at[r]] = h
            whole[at[short]] = True
    return out[whole], rows[whole]


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by row, then value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[new], rows[new]
    return values, rows
