"""Hashes of byte strings, words and word sequences in numpy, the same in every task.

A string's hash is a polynomial over its symbols, so that the hash of any part of a
sequence comes from two prefix sums.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def byte_values(seed: int) -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, BLOCK_BYTES + 4096)
            for name, base in (("up", BASE), ("down", INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.cumprod(table, dtype=np.uint64))
        return cls.up, cls.down


class Hashes:
    """Hashes of any parts of a sequence of 64-bit symbols in constant time each."""

    def __init__(self, symbols: np.ndarray):
        self.up, self.down = Powers.get(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[:len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of bytes flagged ``inside``, in texts that lie end to end."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each of the ascending spans; at most a block of bytes is expanded at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right"))
        if to > at:
            low = int(starts[at])
            out[at:to] = Hashes(values[data[low:int(ends[to - 1])]]).of(starts[at:to] - low, ends[at:to] - low)
        else:  # one span longer than a block, part by part
            total, to = 0, at + 1
            for low in range(int(starts[at]), int(ends[at]), BLOCK_BYTES):
                part = Hashes(values[data[low:min(low + BLOCK_BYTES, int(ends[at]))]])
                total += int(part.sums[-1]) * pow(int(BASE), low - int(starts[at]), 1 << 64)
            size = int(ends[at] - starts[at])
            out[at] = mixed(np.array([(total + size) & ((1 << 64) - 1)], np.uint64))[0]
        at = to
    return out
