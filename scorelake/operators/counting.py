"""Interval counts of many numeric columns in few passes.

Columns are taken ``COLUMNS`` at a time, so a plan has the same size however wide the table
is, and each pass reads only its own columns.  Break arrays travel once with the function;
a task places every value by binary search and keeps one dense (column x interval x outcome) count
array, of which it returns the filled cells.  No value leaves its task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col
from scorelake.functions.target import TargetSpec

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = 256
MISSING = -1  # the interval of nulls
CELLS = "place int, interval int, row_count long, good_count long, bad_count long"


def chunks(columns: Sequence[str], size: int = COLUMNS) -> Iterator[list[str]]:
    for start in range(0, len(columns), size):
        yield list(columns[start : start + size])


def _counter(breaks: list[np.ndarray]):
    width = 1 + max(len(b) + 1 for b in breaks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(breaks), width * 3), np.int64)
        for batch in batches:
            flat = batch["x"].flatten()
            shape = (batch.num_rows, len(breaks))
            values = flat.to_numpy(zero_copy_only=False).reshape(shape)
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(shape)
            outcome = batch["outcome"].to_numpy(zero_copy_only=False)
            for j, edges in enumerate(breaks):
                place = np.where(there[:, j], np.searchsorted(edges, values[:, j], side="left") + 1, 0)
                total[j] += np.bincount(place * 3 + outcome, minlength=width * 3)
        yield _filled_cells(total, width)

    return count


def _filled_cells(total: np.ndarray, width: int) -> pa.RecordBatch:
    """The filled cells of ``(column, interval x outcome)`` counts, whose first interval is that of the nulls."""
    cells = total.reshape(len(total), width, 3)
    column, place = np.nonzero(cells.sum(axis=2))
    found = cells[column, place]
    return pa.RecordBatch.from_arrays(
        [pa.array(column.astype(np.int32)), pa.array((place - 1).astype(np.int32)), pa.array(found.sum(axis=1)), pa.array(found[:, 1]), pa.array(found[:, 2])],
        names=["place", "interval", "row_count", "good_count", "bad_count"],
    )


def place_counts(df: DataFrame, places: Sequence[Column], size: int, target: TargetSpec) -> DataFrame:
    """Row, good and bad counts by ``(place, interval)``: the number of a column and its value below ``size``, -1 for null."""
    width, columns = size + 1, len(places)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, width * 3), np.int64)
        for batch in batches:
            at = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, columns).astype(np.int64)
            outcome = batch["outcome"].to_numpy(zero_copy_only=False)
            for j in range(columns):
                total[j] += np.bincount((at[:, j] + 1) * 3 + outcome, minlength=width * 3)
        yield _filled_cells(total, width)

    at = F.array(*[F.coalesce(p.cast("int"), F.lit(MISSING)) for p in places])
    outcome = F.when(target.is_good, 1).when(target.is_bad, 2).otherwise(0).alias("outcome")
    names = ("row_count", "good_count", "bad_count")
    return df.select(outcome, at.alias("x")).mapInArrow(count, CELLS).groupBy("place", "interval").agg(*[F.sum(n).alias(n) for n in names])


def interval_counts(df: DataFrame, columns: Sequence[str], breaks: Mapping[str, Sequence[float]], target: TargetSpec) -> dict[str, dict[int, dict[str, int]]]:
    """Row, good and bad counts of every filled ``(lo, hi]`` interval and of the nulls, by column.

    NaN lies in the last interval, as it sorts after all numbers.  What comes back are the counts of the bins themselves.
    """
    outcome = F.when(target.is_good, 1).when(target.is_bad, 2).otherwise(0).alias("outcome")
    found: dict[str, dict[int, dict[str, int]]] = {c: {} for c in columns}
    names = ("row_count", "good_count", "bad_count")
    for part in chunks(columns):
        rows = df.select(outcome, F.array(*[col(c).cast("double") for c in part]).alias("x"))
        edges = [np.array(list(breaks.get(c) or []), float) for c in part]
        sums = rows.mapInArrow(_counter(edges), CELLS).groupBy("place", "interval").agg(*[F.sum(n).alias(n) for n in names])
        for r in sums.collect():
            found[part[r.place]][r.interval] = {n: r[n] for n in names}
    return found
