"""Near-duplicate embeddings by lattice hashing.

Each table projects the unit vectors at random to one or more groups of eight
dimensions and decodes every group to the nearest point of the E8 lattice; these
points together are the vector's cell.  A vector is entered under its own cell
and looked up there and in the cells that differ from it in one group by one of
its nearest neighbouring points.  Pairs that meet are sifted by a 256-bit sign
sketch, and cosines are then verified in double precision.

The number of groups follows the number of different vectors, so that unrelated
vectors that a vector meets do not grow with the table (``MET``), and the number
of tables follows the groups, so that a pair at the threshold is missed with
probability ``miss`` at most, whatever the size; nearer pairs meet more surely.
Both come from ``layout``, which draws the meeting rates from a fixed seed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; equal
vectors are compared once and all linked; a row without an id counts as the
largest id; an empty table gives an empty table; input columns pass through,
``n_links``, ``component_id`` and ``kept`` replace input columns of those names.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.blocks import block_pairs, classes_of, exact_links, forest, groups, link_rows, named_texts
from scorelake.llm.common import col, ordered_id, packed, stage, unpacked
from scorelake.llm.components import components
from scorelake.llm.words import mix

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEIGHBOURS = 4  # neighbouring points looked up in each group
SCALE = 0.3  # of the lattice, for projections whose coordinates have a spread of 1/8
MISS = 1e-3  # probability that a pair at the threshold meets in no table
MET = 1000  # unrelated vectors that a vector may meet, on average
CELL_BLOCK = 1024  # vectors in a block of a cell
SKETCH_BITS = 256
SKETCH_SPREADS = 5.8  # standard deviations of differing bits that are let pass



def e8_roots() -> np.ndarray:
    """The 240 shortest lattice vectors, which lead to the neighbouring cells."""
    whole = [
        np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)
    ]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    point = np.rint(y)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(y - point)[odd].argmax(axis=1)
    point[odd, worst] += np.where(y[odd, worst] >= point[odd, worst], 1, -1)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def meeting_rates(cosine: float, scale: float, neighbours: int, trials: int = 40_000) -> tuple[float, float]:
    """How often two unit vectors of this cosine have the same point in a group, or one of the nearest neighbouring points."""
    rng = np.random.default_rng(8)
    y = rng.normal(size=(trials, 8)) / 8 / scale + rng.uniform(-2, 2, (trials, 8))
    here = nearest_e8(y)
    there = nearest_e8(y + rng.normal(size=(trials, 8)) / 8 / scale * np.sqrt(2 - 2 * cosine))
    step = there - here
    same = ~step.any(axis=1)
    near = _nearest_roots(y - here, e8_roots(), neighbours)
    return same.mean(), (near == step[:, None, :]).all(axis=2).any(axis=1).mean()


def layout(vectors: int, threshold: float, scale: float = SCALE, neighbours: int = NEIGHBOURS, miss: float = MISS) -> tuple[int, int]:
    """``(groups, tables)`` for this many different vectors."""

    def met(rates: tuple[float, float], groups: int) -> float:
        same, near = rates
        return same**groups + groups * same ** (groups - 1) * near

    linked, unrelated = meeting_rates(threshold, scale, neighbours), meeting_rates(0.0, scale, neighbours)
    groups = 1
    while True:
        found = met(linked, groups)
        tables = 1 if found >= 1 else max(1, int(np.ceil(np.log(miss) / np.log1p(-found))))
        if tables * met(unrelated, groups) * vectors <= MET:
            return groups, tables
        groups += 1


def most_differing(threshold: float) -> int:
    """Differing sketch bits up to which a pair at the threshold is let pass."""
    share = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(np.ceil(SKETCH_BITS * share + SKETCH_SPREADS * np.sqrt(SKETCH_BITS * share * (1 - share))))


def _nearest_roots(offset: np.ndarray, roots: np.ndarray, neighbours: int) -> np.ndarray:
    """The lattice vectors that lead from a point to its nearest neighbours as seen from ``point + offset``."""
    return roots[np.argpartition(-(offset @ roots.T), neighbours, axis=1)[:, :neighbours]]


def _point_keys(points: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of lattice points (last axis of eight)."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = np.full(points.shape[:-1], seed, np.uint64)
    for i in range(8):
        key = mix(key ^ (doubled[..., i] * np.uint64(0x9E3779B97F4A7C15)))
    return key


def _unit_rows(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Row numbers and unit vectors of the usable vectors, by length."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(there, np.diff(ends), 0)
    rows, units = [], []
    for n in np.unique(size[size > 0]):
        row = np.flatnonzero(size == n)
        x = values[ends[row][:, None] + np.arange(n)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (top > 0)
        row, x = row[good], x[good] / top[good, None]
        if len(row):
            rows.append(row)
            units.append(x / np.sqrt((x**2).sum(axis=1))[:, None])
    return rows, units


SKETCH = ["s1", "s2", "s3", "s4"]
_ENTRIES = "node long, copies long, s1 long, s2 long, s3 long, s4 long, unit binary, own array<long>, near array<long>"


def _hasher(groups: int, tables: int, neighbours: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = e8_roots()
        drawn: dict[int, tuple] = {}
        for batch in batches:
            for row, x in zip(*_unit_rows(batch.column(2)), strict=True):
                n = x.shape[1]
                if n not in drawn:
                    rng = np.random.default_rng(n)
                    planes = rng.normal(size=(tables, groups, n, 8)) / 8
                    drawn[n] = planes, rng.uniform(-2, 2, (tables, groups, 8)), rng.normal(size=(n, SKETCH_BITS))
                planes, shifts, signs = drawn[n]
                own = np.empty((len(row), tables), np.int64)
                near = np.empty((len(row), tables, groups * neighbours), np.int64)
                for t in range(tables):
                    # A cell's key is the sum of its points' hashes, so a neighbour's differs by one term.
                    total, changed = np.zeros(len(row), np.uint64), []
                    for g in range(groups):
                        y = x @ planes[t, g] / scale + shifts[t, g]
                        point = nearest_e8(y)
                        seed = (t * groups + g) * 1_000_003 + n
                        mine = _point_keys(point, seed)
                        beside = point[:, None, :] + _nearest_roots(y - point, roots, neighbours)
                        changed.append(_point_keys(beside, seed) - mine[:, None])
                        total += mine
                    own[:, t] = mix(total).view(np.int64)
                    near[:, t] = mix(total[:, None] + np.concatenate(changed, axis=1)).view(np.int64)
                sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                listed = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * np.int32(k.shape[1])), pa.array(k.ravel()))
                    for k in (own, near.reshape(len(row), -1))
                ]
                ids = [batch.column(i).take(pa.array(row)) for i in range(2)]
                units = pa.array([u.tobytes() for u in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*ids, *(pa.array(np.ascontiguousarray(s)) for s in sketch.T), units, *listed],
                    names=["node", "copies", *SKETCH, "unit", "own", "near"],
                )

    return run


def _cell_comparer(limit: int):
    """Candidate links of cell blocks sorted by ``(cell, pa, pb)``, entries first: entries with entries and visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["cell", "pa", "pb"], whole=False):
            cell, pa_, pb_, block, node = (rows.column(c).to_numpy() for c in ("cell", "pa", "pb", "block", "node"))
            # Unsigned: bits of a signed number would be counted of its magnitude.
            sketch = np.column_stack([rows.column(c).to_numpy().view(np.uint64) for c in SKETCH])
            entry = rows.column("entry").to_numpy(zero_copy_only=False)
            left, right = [], []
            i = np.flatnonzero(entry)  # entries come first in their group
            for lag in range(1, rows.num_rows):
                i = i[: np.searchsorted(i, rows.num_rows - lag)]
                j = i + lag
                same = (cell[j] == cell[i]) & (pa_[j] == pa_[i]) & (pb_[j] == pb_[i])
                i, j = i[same], j[same]
                if not len(i):
                    break
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= limit
                near &= ((pa_[i] == pb_[i]) | (block[i] != block[j])) & (node[i] != node[j])
                left.append(i[near])
                right.append(j[near])
            if left and sum(map(len, left)):
                ids, place = np.unique(node, return_inverse=True)
                a, b = forest(len(ids), place[np.concatenate(left)], place[np.concatenate(right)])
                yield link_rows(ids[a], ids[b])

    return run


def _cosines(threshold: float):
    def matrix(rows: pa.RecordBatch) -> np.ndarray:
        units = np.array([np.frombuffer(u.as_py(), np.float64) for u in rows.column("unit")])
        return units @ units.T >= threshold

    return matrix


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def lattice_dedup(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    neighbours: int = NEIGHBOURS,
    scale: float = SCALE,
    miss: float = MISS,
) -> DataFrame:
    """The vectors with ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must lie between 0.5 and 1")
    value = col(vector_col).cast("array<double>")
    same = ["v1", "v2"]
    hashed = [F.xxhash64(value).alias("v1"), F.xxhash64(F.lit("second"), value).alias("v2")]
    rows = vectors.select(ordered_id(id_col).alias("did"), *hashed, value.alias("vector")).filter(_usable(F.col("vector")))
    counted = rows.groupBy(*same).agg(F.min("did").alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = stage(named_texts(counted, same))
    groups, tables = layout(named.count(), threshold, scale, neighbours, miss)
    first = rows.join(named.withColumnRenamed("rep", "did"), ["did", *same]).dropDuplicates(["did", *same])
    reps = stage(first.select("node", "copies", "vector").mapInArrow(_hasher(groups, tables, neighbours, scale), _ENTRIES))

    sketch = ["node", *SKETCH]
    entries = reps.select(*sketch, F.explode("own").alias("cell"), F.lit(True).alias("entry"))
    visits = reps.select(*sketch, F.explode("near").alias("cell"), F.lit(False).alias("entry"))
    met = entries.union(visits)
    # Only crowded cells are cut into blocks; they are few, at most one in CELL_BLOCK rows.
    crowded = stage(met.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > CELL_BLOCK))
    keys = ["cell", "pa", "pb"]
    candidates = (
        block_pairs(met.join(crowded, "cell", "left"), F.coalesce("members", F.lit(1)), CELL_BLOCK)
        .select(*keys, "block", *sketch, "entry")
        .repartition(*keys)
        .sortWithinPartitions(*keys, F.desc("entry"))
        .mapInArrow(_cell_comparer(most_differing(threshold)), "a long, b long")
    )
    grouped = components(candidates)
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    asked = reps.select("node", "copies", "unit").join(grouped.join(sizes, "component"), "node")
    known = classes_of(named, same, *exact_links(asked, "unit", _cosines(threshold)))

    out = vectors.select(ordered_id(id_col).alias("did"), *hashed, packed(vectors).alias("row")).join(known, same, "left")
    component = F.coalesce("class_id", "did")
    return unpacked(
        out, "row", vectors.columns, n_links=F.coalesce("n_links", F.lit(0)).cast("long"), component_id=component,
        kept=component == F.col("did"),
    )
