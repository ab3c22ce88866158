"""Hashed character trigrams of whole texts, and linear models on them."""

from __future__ import annotations

import numpy as np

BUCKETS = 4096  # a power of two
_PIECE = 1 << 20
# Letters stay, in lower case; other ASCII becomes space.  Bytes of other letters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """Lower-case words of letters between single spaces."""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def trigrams(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed byte trigrams of all of data; long data is counted piece by piece."""
    counts = np.zeros(buckets, np.int64)
    shift = np.uint32(33 - buckets.bit_length())
    for start in range(0, max(1, len(data) - 2), _PIECE):
        b = np.frombuffer(data, np.uint8, min(_PIECE + 2, len(data) - start), start).astype(np.uint32)
        if len(b) < 3:
            break
        h = b[:-2] * np.uint32(0x9E3779B1)
        h ^= b[1:-1] * np.uint32(0x85EBCA77)
        h += b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
        counts += np.bincount(h >> shift, minlength=buckets)
    return counts


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: a vector of length one, or of zeros."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Gradient steps with momentum and per-weight scale."""

    def __init__(self, shape, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(shape), np.zeros(shape), 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
