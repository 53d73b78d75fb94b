"""Hashes of substrings in numpy, the same on every worker."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as any text has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, len(self.up) * 5 // 4, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = _cumulative(_BASE, size)
                self.down = _cumulative(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down


def _cumulative(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Substrings:
    """Hashes of substrings of a byte array; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _POWERS.to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes."""
        with np.errstate(over="ignore"):
            n = max(0, len(self.sums) - k)
            return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


#: Hashes of a byte at each of the first places of a word.
_PLACES = 64
_AT_PLACE = mix(np.arange(_PLACES << 8, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of words that stand one after another. Each byte is mixed with its place in the word before the sum is taken,

    so, unlike those of a polynomial modulo 2^64, they don't meet for words with a regular structure.
    """
    size = stops - starts
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    each = at.astype(np.uint64) << np.uint64(8) | data[at + np.repeat(starts, size)]
    near = at < _PLACES
    values = _AT_PLACE[np.where(near, each, 0).astype(np.int64)]
    far = np.flatnonzero(~near)
    with np.errstate(over="ignore"):
        if len(far):
            values[far] = mix(each[far] * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019))
        sums = np.append(np.uint64(0), np.cumsum(values))
        ends = np.cumsum(size)
        return mix(sums[ends] - sums[ends - size] + size.astype(np.uint64))


def sequence_hash(items: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` items (64-bit hashes themselves)."""
    n = max(0, len(items) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ mix(items[i : i + n] + np.uint64(i + 1))) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)
