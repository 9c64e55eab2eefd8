"""Exact nearest neighbours over a space-partition tree.

The tree is cut on the driver from a bounded sample of the points, a node along its widest side at quantiles,
and all points are placed in one pass. A leaf that holds too many after all is cut again at sketched quantiles
of its points, so leaves are bounded whatever the data. Boxes are true minima and maxima of all
points, which makes the search exact whatever the sample:

1. each point meets the points of its own leaf, which bounds its k-th distance, and descends the tree to every other
   leaf whose box lies within that bound;
2. it probes these leaves;
3. a point that probed ranks the best k of all its answers; the others have them from their own leaf and are not moved again.

A leaf and at most ``PROBES`` probing points meet in one task, so neither a crowded
region nor a leaf that many points probe grows a task. What the driver and every task hold is the tree: two
corners a node, and nodes are bounded by ``MAX_LEAVES``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorelake.functions.columns import col, constants
from scorelake.functions.state import stage

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 512  # points a leaf is to hold; more where the tree would pass MAX_LEAVES
MAX_LEAVES = 1 << 16
FAN = 8  # children of a node at most
PROBES = 16_384  # points that meet a leaf in one task
CELLS = 1 << 16  # distances computed at a time; as many as stay in a core's cache
SAMPLED = 32  # sampled points a leaf, which place the first cuts
MAX_SAMPLED = 1 << 23  # numbers in that sample
CROWDED = 4  # leaves of more points than this many times the wanted ones are cut again


@dataclass
class Tree:
    """Nodes by number: the box corners, and for inner nodes the side they are cut on, the cuts and the children."""

    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    side: dict[int, int] = field(default_factory=dict)
    cuts: dict[int, list[float]] = field(default_factory=dict)
    children: dict[int, list[int]] = field(default_factory=dict)
    roots: list[int] = field(default_factory=list)


def _with(frame: DataFrame, columns: str) -> StructType:
    return StructType(frame.schema.fields + StructType.fromDDL(columns).fields)


def _boxes(points: DataFrame, d: int) -> pa.Table:
    """Count and corners of every node with points; one row per node reaches the driver."""
    sides = [f(F.col("x")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *sides).toArrow()


def _widest(low: np.ndarray, high: np.ndarray) -> int:
    return int(np.argmax(np.where(high > low, high - low, 0.0)))


def _cut(tree: Tree, node: int, side: int, quantiles: set[float], least: float) -> None:
    """Children of a node; a value that fills every quantile is cut off from the larger ones."""
    tree.side[node] = side
    tree.cuts[node] = sorted(quantiles - {least}) or [float(np.nextafter(least, np.inf))]
    first, d = len(tree.low), len(tree.low[0])
    tree.children[node] = list(range(first, first + len(tree.cuts[node]) + 1))
    tree.low += [np.full(d, np.inf)] * len(tree.children[node])
    tree.high += [np.full(d, -np.inf)] * len(tree.children[node])


def _cut_by_sample(tree: Tree, points: DataFrame, d: int, size: int, leaf: int) -> None:
    """The first cuts, from points that a hash of their number picks."""
    wanted = max(1, min(MAX_SAMPLED // d, SAMPLED * -(-size // leaf)))
    one_in = max(1, size // wanted)
    drawn = points.filter(F.pmod(F.xxhash64("point"), F.lit(one_in)) == 0).select("x").toArrow()
    todo = [(0, _matrix(drawn["x"], d))]
    while todo:
        node, x = todo.pop()
        stands_for = len(x) * one_in
        if stands_for <= 2 * leaf or not (x.max(0) > x.min(0)).any():
            continue
        side = _widest(x.min(0), x.max(0))
        ordered = np.sort(x[:, side])
        parts = min(FAN, max(2, -(-stands_for // leaf)))
        _cut(tree, node, side, {float(ordered[len(x) * i // parts]) for i in range(1, parts)}, float(ordered[0]))
        child = np.searchsorted(tree.cuts[node], x[:, side], side="right")
        todo += [(n, x[child == i]) for i, n in enumerate(tree.children[node])]


def _placing(tree: Tree, d: int):
    """The leaf of each point, found level by level from the root."""
    inner = np.full(len(tree.low), -1)
    inner[list(tree.children)] = np.arange(len(tree.children))
    side = np.array([tree.side[n] for n in tree.children], np.int64)
    first = np.array([c[0] for c in tree.children.values()], np.int64)
    cuts = np.full((len(tree.children), FAN), np.nan)
    for i, n in enumerate(tree.children):
        cuts[i, : len(tree.cuts[n])] = tree.cuts[n]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], d)
            nodes, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(rows := rows[inner[nodes[rows]] >= 0]):
                at = inner[nodes[rows]]
                nodes[rows] = first[at] + (cuts[at] <= x[rows, side[at], None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes.astype(np.int32))], names=[*batch.schema.names, "node"])

    return place


def grow_tree(points: DataFrame, d: int, leaf: int) -> tuple[Tree, DataFrame, dict[int, int]]:
    """The tree, the staged ``points (point, x, ...)`` with the leaf of each as ``node``, and leaf sizes."""
    tree, sizes = Tree(), {}

    def measured(frame: DataFrame) -> None:
        found = _boxes(frame, d)
        low, high = (np.column_stack([found[f"{name}{i}"].to_numpy() for i in range(d)]) for name in ("lo", "hi"))
        for i, (node, n) in enumerate(zip(found["node"].to_pylist(), found["n"].to_pylist())):
            tree.low[node], tree.high[node], sizes[node] = low[i], high[i], n

    tree.low, tree.high, tree.roots = [np.full(d, np.inf)], [np.full(d, -np.inf)], [0]
    size = points.count()
    leaf = max(leaf, -(-size // MAX_LEAVES))
    if size > 2 * leaf:
        _cut_by_sample(tree, points, d, size, leaf)
    placed = stage(points.mapInArrow(_placing(tree, d), _with(points, "node int")))
    measured(placed)
    _span_children(tree)
    again = False
    while crowded := [n for n, size in sizes.items() if size > CROWDED * leaf and (tree.high[n] > tree.low[n]).any()]:
        again = True
        sides = {n: _widest(tree.low[n], tree.high[n]) for n in crowded}
        table = F.broadcast(constants(points, list(sides.items()), "node int, side int"))
        at = F.get("x", F.col("side"))
        shares = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
        sketches = placed.join(table, "node").groupBy("node").agg(F.percentile_approx(at, shares, F.lit(1000)).alias("cuts"), F.min(at).alias("least"))
        for r in sketches.collect():
            parts = min(FAN, max(2, -(-sizes.pop(r.node) // leaf)))
            _cut(tree, r.node, sides[r.node], {r.cuts[round(i * FAN / parts) - 1] for i in range(1, parts)}, r.least)
        rows = [(n, tree.side[n], tree.cuts[n], tree.children[n][0]) for n in crowded]
        moves = F.broadcast(constants(points, rows, "node int, side int, cuts array<double>, first int"))
        child = F.expr("first + size(filter(cuts, c -> c <= get(x, side)))").cast("int")
        placed = placed.join(moves, "node", "left").select(*points.columns, F.coalesce(child, "node").alias("node"))
        measured(placed.filter(F.col("node") >= min(r[3] for r in rows)))
    return tree, stage(placed) if again else placed, sizes


def _span_children(tree: Tree) -> None:
    """Boxes of inner nodes from those of their children, which have higher numbers."""
    for n in sorted(tree.children, reverse=True):
        tree.low[n] = np.min([tree.low[c] for c in tree.children[n]], axis=0)
        tree.high[n] = np.max([tree.high[c] for c in tree.children[n]], axis=0)


def _nearest(points: np.ndarray, ids: np.ndarray, asked: np.ndarray, asking: np.ndarray, bound: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of ``points`` within each asking point's bound: its row, the neighbour's id, the squared distance."""
    rows, found, gaps = [], [], []
    step = max(1, CELLS // max(len(ids), 1))
    for start in range(0, len(asking), step):
        part = slice(start, start + step)
        gap = np.zeros((len(asking[part]), len(ids)))
        for i in range(points.shape[1]):
            difference = asked[part, i, None] - points[None, :, i]
            gap += difference * difference
        gap[asking[part, None] == ids[None, :]] = np.inf
        limit = np.full(len(gap), np.inf) if bound is None else bound[part]
        if gap.shape[1] > k:
            limit = np.minimum(limit, np.partition(gap, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero(gap <= limit[:, None])
        finite = np.isfinite(gap[r, c])
        r, c = r[finite], c[finite]
        order = np.lexsort((ids[c], gap[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        rows.append(r[keep] + start), found.append(ids[c[keep]]), gaps.append(gap[r[keep], c[keep]])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(gaps)


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in chunks]]).reshape(-1, d)


FOUND = "found array<struct<gap: double, neighbour: long>>"


def _lists(rows: np.ndarray, ids: np.ndarray, gaps: np.ndarray, n: int) -> pa.Array:
    """The answers of ``n`` points, a list for each."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(gaps), pa.array(ids)], names=["gap", "neighbour"]))


def _descent(tree: Tree, d: int):
    """Other leaves within each point's bound, found level by level from the root; a list for each point."""
    low, high = np.array(tree.low), np.array(tree.high)
    first = np.zeros(len(low), np.int64)
    count = np.zeros(len(low), np.int64)
    for node, children in tree.children.items():
        first[node], count[node] = children[0], len(children)

    def descend(x: np.ndarray, home: np.ndarray, bound: np.ndarray) -> pa.Array:
        rows, nodes, asked = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(rows):
            near = np.zeros(len(rows))
            for i in range(d):
                at = x[rows, i]
                gap = np.maximum(np.maximum(low[nodes, i] - at, at - high[nodes, i]), 0.0)
                near += gap * gap
            keep = near <= bound[rows]
            rows, nodes = rows[keep], nodes[keep]
            done = count[nodes] == 0
            out = done & (nodes != home[rows])
            asked.append((rows[out], nodes[out]))
            rows, nodes = rows[~done], nodes[~done]
            repeat = count[nodes]
            step = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            rows, nodes = np.repeat(rows, repeat), np.repeat(first[nodes], repeat) + step
        rows, nodes = (np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 2, *asked))
        order = np.argsort(rows, kind="stable")
        ends = np.searchsorted(rows[order], np.arange(len(x) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes[order].astype(np.int32)))

    return descend


def _own(tree: Tree, k: int, d: int):
    descend = _descent(tree, d)

    def search(leaf: pa.Table) -> pa.Table:
        x, ids = _matrix(leaf["x"], d), leaf["point"].to_numpy()
        rows, near, gaps = _nearest(x, ids, x, ids, None, k)
        # A point alone in its leaf has no bound and probes all leaves.
        bound = np.full(len(ids), np.inf)
        full = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1)
        bound[rows[full]] = gaps[full]
        answered = leaf.append_column("found", _lists(rows, near, gaps, len(ids))).append_column("bound", pa.array(bound))
        return answered.append_column("probes", descend(x, leaf["node"].to_numpy(), bound))

    return search


def _descents(tree: Tree, d: int):
    """``_own`` for rows that have their answers and bounds."""
    descend = _descent(tree, d)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probes = descend(_matrix(batch["x"], d), batch["node"].to_numpy(), batch["bound"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, probes], names=[*batch.schema.names, "probes"])

    return search


def _within(k: int, d: int):
    def search(leaf: pa.Table, asked: pa.Table) -> pa.Table:
        if not leaf.num_rows or not asked.num_rows:
            return pa.table({"point": pa.array([], pa.int64()), "found": _lists(*[np.zeros(0, t) for t in (np.int64, np.int64, float)], 0)})
        asking, bound = asked["point"].to_numpy(), asked["bound"].to_numpy()
        answers = _nearest(_matrix(leaf["x"], d), leaf["point"].to_numpy(), _matrix(asked["x"], d), asking, bound, k)
        found = pa.table({"point": asking, "found": _lists(*answers, len(asking))})
        return found.take(np.unique(answers[0]))

    return search


def _asked(leaves: DataFrame, probes: DataFrame, sizes: dict[int, int], k: int, d: int) -> DataFrame:
    """Answers of the leaves to their probes, a block of probes at a time."""
    table = F.broadcast(constants(leaves, [(n, -(-size // PROBES)) for n, size in sizes.items()], "node int, blocks int"))
    block = F.pmod(F.hash("point"), F.col("blocks")).alias("block")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    held = leaves.join(table, "node").select("node", blocks, "point", "x")
    asking = probes.join(table, "node").select("node", block, "point", "x", "bound").toDF("node", "block", "point", "x", "bound")
    return held.groupBy("node", "block").cogroup(asking.groupBy("node", "block")).applyInArrow(_within(k, d), f"point long, {FOUND}")


def _in_own_leaf(tree: Tree, placed: DataFrame, sizes: dict[int, int], k: int, d: int) -> DataFrame:
    """``placed`` with the k nearest of the leaf, the k-th distance squared and the leaves to probe."""
    if max(sizes.values(), default=0) <= PROBES:
        return placed.groupBy("node").applyInArrow(_own(tree, k, d), _with(placed, f"{FOUND}, bound double, probes array<int>"))
    found = _asked(placed, placed.withColumn("bound", F.lit(float("inf"))), sizes, k, d)
    none = F.array().cast(FOUND.split(" ", 1)[1])
    bound = F.when(F.size("found") >= k, F.element_at("found", -1)["gap"]).otherwise(float("inf"))
    known = placed.join(found, "point", "left").select(*placed.columns, F.coalesce("found", none).alias("found")).withColumn("bound", bound)
    return known.mapInArrow(_descents(tree, d), _with(known, "probes array<int>"))


def neighbour_lists(points: DataFrame, features: Sequence[str], k: int, leaf: int = LEAF, keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest of distinct points: ``(point, x, keep..., found)``.

    ``found`` is an array of ``(gap, neighbour)`` in order, gaps being squared distances, and ``x`` holds the features.
    ``points`` has a unique ``point`` id and features without null or NaN. It is read a few times.
    """
    d = len(features)
    x = F.array(*[col(f).cast("double") for f in features]).alias("x")
    spots = points.select(F.col("point").cast("long").alias("point"), x, *keep)
    tree, placed, sizes = grow_tree(spots, d, leaf)
    own = stage(_in_own_leaf(tree, placed, sizes, k, d))
    probes = own.select("point", "x", "bound", F.explode("probes").alias("node"))
    asked = {r.node: r.n for r in probes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per leaf
    listed, settled = ["point", "x", *keep, "found"], F.size("probes") == 0
    if not asked:
        return own.select(*listed)
    asked_leaves = placed.join(F.broadcast(constants(spots, [(n,) for n in asked], "node int")), "node", "left_semi")
    other = _asked(asked_leaves, probes, asked, k, d).groupBy("point").agg(F.flatten(F.collect_list("found")).alias("others"))
    best = F.slice(F.array_sort(F.concat("found", "others")), 1, k)
    probing = own.filter(~settled).join(other, "point", "left").withColumn("found", F.coalesce(best, "found"))
    return own.filter(settled).select(*listed).union(probing.select(*listed))


def nearest_neighbours(points: DataFrame, features: Sequence[str], k: int, leaf: int = LEAF) -> DataFrame:
    """The k nearest of distinct points: ``(point, neighbour, distance, rank)``, equal distances by neighbour."""
    listed = neighbour_lists(points, features, k, leaf).select("point", F.posexplode("found").alias("at", "near"))
    return listed.select("point", F.col("near.neighbour").alias("neighbour"), F.sqrt("near.gap").alias("distance"), (F.col("at") + 1).alias("rank"))
