"""Hashes of all words of many texts by array operations."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = n + (n >> 3)
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _R), ("down", inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, text after text, and the n + 1 offsets of the texts' words. Words are runs without white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        p = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * up[:n] + up[:n], out=p[1:])
        h = mixed((p[e] - p[b]) * down[b])
    return h, np.searchsorted(b, offsets)
