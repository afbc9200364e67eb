"""Vectorised Karp-Rabin hashes over code points, modulo 2**64."""

from __future__ import annotations

import numpy as np

# Fixed values of this engine: an odd base, its inverse modulo 2**64, and mixing constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX_AGAIN = np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * MIX_AGAIN
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            one = np.ones(size, np.uint64)
            up, down = one.copy(), one
            up[1:] = np.uint64(BASE)
            down[1:] = np.uint64(INVERSE)
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


class Hashes:
    """Hashes of any stretches of one text in constant time each."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sliding(values: np.ndarray, width: int, best: np.ufunc, neutral: int) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of ``width`` values, by block prefixes and suffixes."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, neutral, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    before = best.accumulate(grid, axis=1).ravel()
    after = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])
