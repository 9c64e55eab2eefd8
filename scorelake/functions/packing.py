"""Arrays of one length as bytes that compress, for rows that hold many numbers."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pack(arrays: Sequence[np.ndarray]) -> bytes:
    """First bytes of all numbers, then the second ones, and so on: equal bytes lie together, so the codec of exchanges finds them."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)


def unpack(data: bytes, n: int, kinds: Sequence[type]) -> list[np.ndarray]:
    """The arrays of ``n`` numbers of these kinds that were packed."""
    arrays, start = [], 0
    for kind in map(np.dtype, kinds):
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, start).reshape(kind.itemsize, n)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        start += n * kind.itemsize
    return arrays
