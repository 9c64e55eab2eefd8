"""Sharding by histogram sort: byte-exact splitters first, then one exchange.

Rows are ordered by (hash of the text, id).  Counting rounds run over the bare
keys: every partition adds up bytes and rows between the candidate boundaries
(*probes*), the sums of all partitions give the exact bytes below each probe,
and the probes close in on every target until the nearest boundary lies within
the tolerance.  Only then do the rows move, once, into cells of a bounded size
whose place within the shard is known already.

Law ``bytes``: each shard's bytes miss the equal share by at most about
``tolerance`` of a share plus one row.  Equal texts lie side by side in the
order, so a group of them is cut only by a boundary inside it.

Defined cases: a null text has no bytes and sorts as the empty text; rows
without an id sort last among equal texts; rows alike in id and text are one
key and are never parted, whatever they weigh; an empty table gives an empty
table; input columns pass through, ``size``, ``shard`` and ``slot`` replace
input columns of those names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import col, ordered_id, packed, stage, text_of, unpacked

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PROBES = 100_000  # per counting round, whatever the data
_COUNTS = "bucket int, bytes long, rows long, low binary, high binary"


def _sortable(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Two signed longs as 16 bytes that compare as the pair does."""
    flip = np.uint64(1 << 63)
    both = np.stack([k1.astype(np.int64).view(np.uint64) ^ flip, k2.astype(np.int64).view(np.uint64) ^ flip], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _to_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], dtype="S16")


def _counter(probes: np.ndarray):
    """Counts a partition's bytes, rows and extreme keys between the probes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low: list[bytes | None] = [None] * n
        high: list[bytes | None] = [None] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, size = (batch.column(i).to_numpy() for i in range(3))
            keys = _sortable(k1, k2)
            order = np.argsort(keys, kind="stable")
            keys, size = keys[order], size[order]
            bucket = np.searchsorted(probes, keys, side="right")
            present, start = np.unique(bucket, return_index=True)
            end = np.append(start[1:], len(keys))
            total[present] += np.add.reduceat(size, start)
            rows[present] += end - start
            for b, i, j in zip(present, start, end, strict=True):
                least, most = bytes(keys[i]).ljust(16, b"\0"), bytes(keys[j - 1]).ljust(16, b"\0")
                low[b] = least if low[b] is None else min(low[b], least)
                high[b] = most if high[b] is None else max(high[b], most)
        seen = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(seen.astype(np.int32)), pa.array(total[seen]), pa.array(rows[seen]),
                pa.array([low[b] for b in seen], pa.binary()), pa.array([high[b] for b in seen], pa.binary()),
            ],
            names=["bucket", "bytes", "rows", "low", "high"],
        )

    return count


@dataclass
class Cells:
    """Boundaries of the cells in rising order, their shards and first slots."""

    bounds: list[int]
    shard: list[int]
    first_slot: list[int]
    rounds: int


def _histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    counted = keys.mapInArrow(_counter(_to_bytes(probes)), _COUNTS)
    merged = counted.groupBy("bucket").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return sorted(
        (r.bucket, r.bytes, r.rows, int.from_bytes(r.low, "big"), int.from_bytes(r.high, "big")) for r in merged.collect()
    )


def _probes_between(low: int, high: int, n: int) -> list[int]:
    """The interval's ends, evenly spaced keys, and the edges of the outermost first-key groups."""
    found = {low + (high - low) * i // (n + 1) for i in range(n + 1)} | {high}
    if low >> 64 != high >> 64:
        found |= {(high >> 64) << 64, ((low >> 64) + 1) << 64}
    return [k for k in found if low <= k <= high]


def find_cells(keys: DataFrame, shards: int, tolerance: float, cell_bytes: int) -> Cells:
    """Refine splitters over ``(k1, k2, size)`` until each meets its tolerance."""
    found = _histogram(keys, [])
    if not found:
        return Cells([], [0], [0], 0)
    _, total, _, low, high = found[0]
    per_shard = max(1, -(-total // (shards * cell_bytes)))
    n = shards * per_shard
    share = total / shards
    # Cell boundaries inside a shard only bound a task's size; those between shards are the law.
    allowed = {j: share * (tolerance if j % per_shard == 0 else 0.1 / per_shard) for j in range(1, n)}
    wide = {j: (low, high) for j in range(1, n)}
    done: dict[int, tuple[int, int]] = {}
    rounds = 0
    while wide:
        rounds += 1
        each = max(2, min(64, MAX_PROBES // len(wide)))
        probes = sorted({k for a, b in set(wide.values()) for k in _probes_between(a, b, each)})
        buckets, below, rows_below = [], 0, 0
        for _, size, rows, a, b in _histogram(keys, probes):
            buckets.append((below, rows_below, a, b, size, rows))
            below, rows_below = below + size, rows_below + rows
        starts = np.array([b[0] for b in buckets])
        for j in list(wide):
            target = total * j / n
            i = int(np.searchsorted(starts, target, side="right")) - 1
            before, rows_before, a, b, size, rows = buckets[max(i, 0)]
            near = target - before <= before + size - target
            miss = target - before if near else before + size - target
            if miss <= allowed[j] or a == b:
                done[j] = (a, rows_before) if near else (b + 1, rows_before + rows)
                del wide[j]
            else:
                wide[j] = (a, b)
    bounds = [done[j] for j in range(1, n)]
    starts_at = [0] + [rows for _, rows in bounds]
    shard = [j // per_shard for j in range(n)]
    slots = [starts_at[j] - starts_at[shard[j] * per_shard] for j in range(n)]
    return Cells([k for k, _ in bounds], shard, slots, rounds)


def shard_by_bytes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    row_overhead: int = 8,
    tolerance: float = 0.001,
    cell_bytes: int = 256 << 20,
) -> DataFrame:
    """The documents with ``size``, ``shard`` and ``slot`` (gapless from 0 within the shard)."""
    size = F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("long") + F.lit(row_overhead)
    keyed = docs.select(F.xxhash64(text_of(text_col)).alias("k1"), ordered_id(id_col).alias("k2"), size.alias("size"))
    cells = find_cells(stage(keyed), shards, tolerance, cell_bytes)
    bounds, shard_of, slot_of = _to_bytes(cells.bounds), np.array(cells.shard, np.int32), np.array(cells.first_slot, np.int64)

    @F.pandas_udf("cell int, shard int, first_slot long")
    def place(k1: pd.Series, k2: pd.Series) -> pd.DataFrame:
        cell = np.searchsorted(bounds, _sortable(k1.to_numpy(), k2.to_numpy()), side="right")
        return pd.DataFrame({"cell": cell.astype(np.int32), "shard": shard_of[cell], "first_slot": slot_of[cell]})

    rows = docs.select(
        F.xxhash64(text_of(text_col)).alias("k1"), ordered_id(id_col).alias("k2"), size.alias("size"), packed(docs).alias("row")
    ).withColumn("place", place("k1", "k2"))
    within = Window.partitionBy("place.cell").orderBy("k1", "k2")
    placed = rows.withColumn("slot", F.col("place.first_slot") + F.row_number().over(within) - 1)
    return unpacked(placed, "row", docs.columns, size=F.col("size"), shard=F.col("place.shard"), slot=F.col("slot"))
