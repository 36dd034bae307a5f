"""Words of a text as spans of its UTF-8 bytes, and hashes of spans, in numpy.

White space is ASCII only, so it never lies within a character. A span's hash comes from a running polynomial sum
modulo 2**64 over random values of its bytes; it depends on the bytes alone, and is the same on every machine.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: fixed seed: hashes must agree between workers and runs
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size <= 1 << 19:  # the table of a long text isn't kept
            _tables[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def as_bytes(text: str | bytes | None) -> np.ndarray:
    return np.frombuffer(text.encode() if isinstance(text, str) else text or b"", dtype=np.uint8)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[0::2], edge[1::2]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans(~SPACE[data])


class Hasher:
    """Hashes of spans of one text."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.sums)
        raw = (self.sums[ends] - self.sums[starts]) * _powers(_INVERSE, n)[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


_STEP = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(16)], dtype=np.uint64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` neighbours."""
    n = len(hashes) - k + 1
    if n < 1:
        return hashes[:0]
    out = hashes[:n] * _STEP[0]
    for i in range(1, k):
        out = out + hashes[i : i + n] * _STEP[i]
    return mix(out)


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def shingles(text: str | bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``k`` words, A-Z in lower case; a shorter text is one shingle."""
    data = LOWER[as_bytes(text)]
    starts, ends = words(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    own = Hasher(data)(starts, ends)
    if len(own) >= k:
        return np.unique(windows(own, k))
    return windows(np.concatenate((own, np.full(k - len(own), len(own), dtype=np.uint64))), k)
