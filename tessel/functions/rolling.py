"""Vectorised rolling hashes over sequences of numbers, and of the code points of texts."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEAR = mix(np.arange(1 << 16, dtype=np.uint64) + MULTIPLIER)


def gear(points: np.ndarray) -> np.ndarray:
    """A random 64-bit value of each code point."""
    if not len(points) or int(points.max()) < 1 << 16:
        return _GEAR[points]
    return np.where(points < 1 << 16, _GEAR[points & 0xFFFF], mix(points.astype(np.uint64) + MULTIPLIER))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gear_hash(g: np.ndarray) -> np.ndarray:
    """h[p] = sum of g[p - j] << j over the 64 newest values: the gear hash, by doubling the window six times."""
    h = g.copy()
    for width in (1, 2, 4, 8, 16, 32):
        h[width:] = h[width:] + (h[:-width] << np.uint64(width)) if width < len(h) else h[width:]
    return h


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def window_hash(g: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of each stretch of ``size`` values, by differences of prefix sums."""
    global _POWERS, _INVERSE
    if len(g) < size:
        return np.empty(0, np.uint64)
    if len(_POWERS) < len(g):
        n = 1 << (len(g) - 1).bit_length()
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        _POWERS, _INVERSE = np.full(n, MULTIPLIER), np.full(n, inverse)
        _POWERS[0] = _INVERSE[0] = 1
        _POWERS, _INVERSE = np.multiply.accumulate(_POWERS), np.multiply.accumulate(_INVERSE)
    total = np.cumsum(g * _POWERS[: len(g)])
    part = total[size - 1 :].copy()
    part[1:] -= total[:-size]
    return part * _INVERSE[: len(part)]


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of each window of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(out) - (width - have)], out[width - have :]) if width > have else out
