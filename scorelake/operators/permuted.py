"""Hits of a tree model on permuted rows, without joining rows to rows.

A tree model tells rows apart by the interval of each feature between its thresholds, so a row is a few packed
numbers.  A permutation is two hash orders side by side: rows are sent to slices of ranks, packed, in both
orders, and every slice is sorted and lined up on its own.  Buckets of hashes are counted beforehand, so a slice knows the rank of its
first row; a bucket that lies across a border of slices is sent to both and cut there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.columns import col
from scorelake.functions.hashing import hash_order
from scorelake.functions.packing import pack, unpack
from scorelake.functions.state import shuffles_released, stage
from scorelake.operators.trees import Forest, probabilities

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_ROWS = 500_000  # ranks that are lined up in one task
SLICE_BUCKETS = 16  # buckets of hashes in a slice, about
FLUSH_ROWS = 500_000  # rows that a task holds before it sends them
SCORED_ROWS = 65_536  # pairs that are scored together
MAX_BITS = 20
WORD = 1 << 62  # values of one packed number


@dataclass(frozen=True)
class Cells:
    """A row's class and the intervals of its features as packed numbers."""

    cuts: tuple[np.ndarray, ...]  # thresholds of each feature, ascending

    def places(self) -> list[tuple[int, int, int]]:
        """Word, factor and size of the class and of every feature."""
        found, word, factor = [], 0, 1
        for size in (2, *(len(c) + 1 for c in self.cuts)):
            if factor * size > WORD:
                word, factor = word + 1, 1
            found.append((word, factor, size))
            factor *= size
        return found

    @property
    def words(self) -> int:
        return self.places()[-1][0] + 1

    def packed(self, label: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        made = [np.zeros(len(x), np.int64) for _ in range(self.words)]
        digits = [label.astype(np.int64), *(np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts))]
        for (word, factor, _), digit in zip(self.places(), digits):
            made[word] += digit * factor
        return made

    def rows(self, words: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The class, and values that a model's tests answer as they answer the row's own."""
        (label, *digits) = [words[word] // factor % size for word, factor, size in self.places()]
        return label == 1, np.stack([np.r_[c, np.inf][d] for c, d in zip(self.cuts, digits)], axis=1)


def cells_of(forest: Forest, features: int) -> Cells:
    cuts: list[list[float]] = [[] for _ in range(features)]
    for left, _, feature, threshold, _ in forest.trees:
        for j, t in zip(feature[left >= 0], threshold[left >= 0]):
            cuts[j].append(t)
    return Cells(tuple(np.unique(np.array(c, float)) for c in cuts))


def _pack_rows(cells: Cells, keys: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, x = batch.column(keys).to_numpy(zero_copy_only=False), batch.column(keys + 1)
                words = cells.packed(label, x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                names = [*batch.schema.names[:keys], *(f"_word{i}" for i in range(len(words)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:keys], *map(pa.array, words)], names=names)

    return place


def _hash_halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    fixed = column.cast(pa.binary(16))
    both = np.frombuffer(fixed.buffers()[1], ">u8")[2 * fixed.offset : 2 * (fixed.offset + len(fixed))].reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def _buckets(high: np.ndarray, bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - bits)).astype(np.int64)


def _count_buckets(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                made = np.stack([np.bincount(_buckets(_hash_halves(c)[0], bits), minlength=1 << bits) for c in batch.columns])
                sums = made if sums is None else sums + made
        if sums is not None:
            order, bucket = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[order, bucket])], names=["place", "bucket", "n"])

    return count


def _runs(hashes: Sequence[np.ndarray], words: Sequence[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The rows in hash order; those alike in hash and words are one row with their count, so a key that repeats stays small."""
    order = np.argsort(hashes[0], kind="stable")
    high = hashes[0][order]
    if (high[1:] == high[:-1]).any():
        order = np.lexsort([*words[::-1], hashes[1], hashes[0]])
    hashes, words, counts = [h[order] for h in hashes], [w[order] for w in words], counts[order]
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in (*hashes, *words)], axis=0)]
    if new.all():
        return hashes, words, counts
    starts = np.flatnonzero(new)
    return [h[starts] for h in hashes], [w[starts] for w in words], np.add.reduceat(counts, starts)


def _send_slices(offsets: tuple[np.ndarray, np.ndarray], bits: int, words: int, slice_rows: int, flush_rows: int):
    """Rows in both orders, for the slices that their buckets lie in; ``offsets`` has the rows below each bucket, and all rows last."""

    def sent(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        made: list[tuple[int, int, int, bytes]] = []
        columns = [np.concatenate(parts) for parts in zip(*held)]
        own = columns[4:]
        for side, upto in enumerate(offsets):
            hashes, kept, counts = _runs(columns[2 * side : 2 * side + 2], own, np.ones(len(own[0]), np.uint32))
            bucket = _buckets(hashes[0], bits)
            first, last = upto[bucket] // slice_rows, (upto[bucket + 1] - 1) // slice_rows
            for k in range(first[0], last[-1] + 1):
                a, b = np.searchsorted(last, k, side="left"), np.searchsorted(first, k, side="right")
                if b > a:
                    made.append((k, side, b - a, pack([c[a:b] for c in (*hashes, *kept, counts)])))
        piece, side, n, data = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(side, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["slice", "side", "n", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([*_hash_halves(batch.column(0)), *_hash_halves(batch.column(1)), *(batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(words))])
                n += batch.num_rows
            if n >= flush_rows:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return send


def _distinct(words: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's number among the distinct rows, and those."""
    if len(words) == 1:
        values, place = np.unique(words[0], return_inverse=True)
        return place, [values]
    order = np.lexsort(list(words[::-1]))
    ordered = [w[order] for w in words]
    new = np.r_[True, np.any([w[1:] != w[:-1] for w in ordered], axis=0)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, [w[new] for w in ordered]


def _slice_hits(forest: Forest, cells: Cells, offsets: tuple[np.ndarray, np.ndarray], bits: int, slice_rows: int):
    """Of one slice of ranks: pairs, and hits with each feature in turn taken from the other order's row."""

    def count(table: pa.Table) -> pa.Table:
        low = table["slice"][0].as_py() * slice_rows
        high = min(low + slice_rows, int(offsets[0][-1]))
        kinds = [np.uint64, np.uint64, *[np.int64] * cells.words, np.uint32]
        sent = list(zip(table["side"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist()))
        sides = []
        for side, upto in enumerate(offsets):
            columns = [np.concatenate(parts) for parts in zip(*(unpack(data, n, kinds) for s, n, data in sent if s == side))]
            hashes, words, counts = _runs(columns[:2], columns[2:-1], columns[-1].astype(np.int64))
            ends = upto[_buckets(hashes[0][:1], bits)[0]] + np.cumsum(counts)
            inside = (ends > low) & (ends - counts < high)
            sides.append((np.minimum(ends[inside], high), [w[inside] for w in words]))
        (ends, own), (other_ends, other) = sides
        stops = np.union1d(ends, other_ends)
        length = np.diff(stops, prepend=low)
        (place, own), (other_place, other) = _distinct(own), _distinct(other)
        pairs, pair = np.unique(place[np.searchsorted(ends, stops)] * len(other[0]) + other_place[np.searchsorted(other_ends, stops)], return_inverse=True)
        rows = np.bincount(pair, length).astype(np.int64)
        hits = np.zeros(len(cells.cuts), np.int64)
        for start in range(0, len(pairs), SCORED_ROWS):
            part, n = pairs[start : start + SCORED_ROWS], rows[start : start + SCORED_ROWS]
            label, x = cells.rows([w[part // len(other[0])] for w in own])
            _, y = cells.rows([w[part % len(other[0])] for w in other])
            for j in range(len(hits)):
                variant = x.copy()
                variant[:, j] = y[:, j]
                hits[j] += n[(probabilities(forest, variant) > 0.5) == label].sum()
        return pa.table({"feature": pa.array(range(len(hits)), pa.int32()), "n": pa.array([int(rows.sum())] * len(hits), pa.int64()), "hits": pa.array(hits)})

    return count


def permuted_hits(
    rows: DataFrame, forest: Forest, features: int, keys: Sequence[str], seed: int, seeds: Sequence[int], slice_rows: int = SLICE_ROWS, flush_rows: int = FLUSH_ROWS
) -> list[list[tuple[int, int]]]:
    """Per seed and feature ``(rows, hits)`` when the row at a rank of ``seed``'s order takes the feature from that seed's row at the rank.

    ``rows`` has the keys, ``label`` and ``x``.  One permutation is exchanged at a time.
    """
    spark, cells = rows.sparkSession, cells_of(forest, features)
    named = [f"_key{i}" for i in range(len(keys))]
    narrow = rows.select(*[col(k).alias(n) for k, n in zip(keys, named)], "label", "x")
    schema = T.StructType([*narrow.schema.fields[: len(keys)], *[T.StructField(f"_word{i}", T.LongType()) for i in range(cells.words)]])
    base = stage(narrow.mapInArrow(_pack_rows(cells, len(keys)), schema))
    n = base.count()
    if not n:
        return [[] for _ in seeds]
    bits = min(MAX_BITS, max(1, int(np.ceil(np.log2(SLICE_BUCKETS * n / slice_rows))))) if n > slice_rows else 1
    hashed = lambda s: F.unhex(hash_order(named, s))
    orders = [seed, *seeds]
    counted = base.select(*[hashed(s).alias(f"_h{i}") for i, s in enumerate(orders)]).mapInArrow(_count_buckets(bits), "place int, bucket int, n long")
    counts = np.zeros((len(orders), 1 << bits), np.int64)
    with shuffles_released(spark):
        for r in counted.groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():
            counts[r["place"], r["bucket"]] = r["n"]
    offsets = np.hstack([np.zeros((len(orders), 1), np.int64), np.cumsum(counts, axis=1)])
    words = [f"_word{i}" for i in range(cells.words)]
    told = []
    for i, s in enumerate(seeds):
        both = (offsets[0], offsets[i + 1])
        sent = base.select(hashed(seed).alias("_h"), hashed(s).alias("_other"), *words).mapInArrow(
            _send_slices(both, bits, cells.words, slice_rows, flush_rows), "slice int, side int, n int, data binary"
        )
        hits = sent.groupBy("slice").applyInArrow(_slice_hits(forest, cells, both, bits, slice_rows), "feature int, n long, hits long")
        with shuffles_released(spark):
            found = hits.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow().to_pylist()
        told.append([(r["n"], r["hits"]) for r in sorted(found, key=lambda r: r["feature"])])
    return told
