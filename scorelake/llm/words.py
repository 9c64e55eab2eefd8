"""Word and shingle hashes of whole Arrow columns, computed in numpy.

A word is a run of ASCII letters, digits and non-ASCII characters; A-Z count as
a-z (callers lower other letters beforehand).  Its 64-bit hash is a polynomial over its bytes, taken from running sums, so
no Python object is made per word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
SEED = 20240229


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="left")))
        yield start, min(stop, len(column))
        start = min(stop, len(column))


class Hasher:
    """Hashes words, or with ``apart`` what lies between these bytes; keeps the powers of the base between chunks."""

    def __init__(self, apart: bytes | None = None):
        rng = np.random.default_rng(SEED)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        code = np.arange(256)
        upper = (code >= ord("A")) & (code <= ord("Z"))
        self.value[code[upper]] = self.value[code[upper] + 32]
        self.in_word = upper | ((code >= ord("a")) & (code <= ord("z"))) | ((code >= ord("0")) & (code <= ord("9"))) | (code >= 128)
        if apart is not None:
            self.in_word = ~np.isin(code, list(apart))
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) >= n:
            return
        for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a string column without nulls, where its rows end, and where words start and last."""
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if not len(data):
            return data, ends, np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = self.in_word[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = ends[:-1][ends[:-1] < len(data)]  # a row ends what the row before it began
        first[cuts] = inside[cuts]
        last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
        return data, ends, np.flatnonzero(first), np.flatnonzero(last)

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and each row's number of words."""
        data, ends, start, stop = self.spans(column)
        return self.hashes(data, start, stop), np.diff(np.searchsorted(start, ends))

    def hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        total = self.value[data]
        total *= self.power[: len(data)]
        np.cumsum(total, out=total)
        hashes = total[stop] if len(stop) else np.zeros(0, np.uint64)
        hashes[start > 0] -= total[start[start > 0] - 1]
        hashes *= self.inverse[start]
        return mix(hashes)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row, and each text's number; a shorter text has one of all its words."""
    n = len(words)
    factors = np.random.default_rng(SEED + 1).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    stop = np.cumsum(counts)
    found = np.zeros(n, np.uint64)
    if n >= k:
        for j in range(k):
            found[: n - k + 1] += words[j : n - k + 1 + j] * factors[j]
    valid = np.ones(n, bool)
    for j in range(1, k):
        valid[stop[stop >= j] - j] = False
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[stop[row] - counts[row] : stop[row]]
        place = stop[row] - counts[row]
        found[place] = np.sum(own * factors[: len(own)]) + np.uint64(len(own))
        valid[place] = True
    return mix(found[valid]), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
