"""Vectorised hashes of stretches of bytes, for use inside tasks."""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 2**64)
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)
_BYTE2 = np.random.default_rng(20240602).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    size = 1 << max(20, (n - 1).bit_length())
    if not any(k >= n for k in _cache):
        _cache.clear()
        up, down = np.full(size, _B, np.uint64), np.full(size, _BI, np.uint64)
        up[0] = down[0] = 1
        _cache[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = next(iter(_cache.values()))
    return up[:n], down[:n]


def prefix(raw: np.ndarray, second: bool = False) -> np.ndarray:
    """Sums from which ``stretch`` takes the hash of any stretch; n + 1 of them. ``second``: of another hash."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_BYTE2 if second else _BYTE)[raw] * _powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end)."""
    down = _powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: True for the bytes between words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words of texts that stand end to end; no word crosses a text's end."""
    inside = ~gap[raw]
    prev = np.zeros(len(raw), bool)
    prev[1:] = inside[:-1]
    first = off[:-1][off[:-1] < len(raw)]
    prev[first] = False
    start = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(len(raw), bool)
    nxt[:-1] = inside[1:]
    last = off[1:] - 1
    nxt[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~nxt) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1
