"""Words of many texts as 64-bit numbers, in whole-array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(size, b, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


_kept_powers = lru_cache(maxsize=4)(_powers)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers, from a small set of sizes."""
    size = 1 << 16
    while size < n:
        size *= 2
    return _kept_powers(base, size) if size <= 1 << 21 else _powers(base, size)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text numbered at once; arrays over them take 8 times as much each.  A longer text is numbered whole.
BLOCK_BYTES = 1 << 19


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word of the texts in turn, and where each text's words begin (one place more than texts)."""
    found, bounds, start, total = [], [np.zeros(1, np.int64)], 0, 0
    for i, text in enumerate(texts):
        if total + len(text) >= BLOCK_BYTES and total:
            found.append(_block_words(texts[start:i]))
            start, total = i, 0
        total += len(text) + 1
    found.append(_block_words(texts[start:]))
    for numbers, own in found:
        bounds.append(own[1:] + bounds[-1][-1])
    return np.concatenate([numbers for numbers, _ in found]), np.concatenate(bounds)


def _block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))])
    white = _WHITE[data]
    before = np.concatenate([[True], white[:-1]])
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(white & ~before)
    up, down = powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(starts, offsets)


def windows(numbers: np.ndarray, length: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A number for every run of ``length`` consecutive words, wherever texts end."""
    n = len(numbers) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(base, len(numbers))
    sums = np.zeros(len(numbers) + 1, dtype=np.uint64)
    np.cumsum(numbers * up[: len(numbers)], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[:n])
