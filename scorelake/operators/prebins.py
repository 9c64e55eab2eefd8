"""Supervised pre-bins: a classification tree per variable, grown on distributed value counts.

Rows are counted once per distinct value and given running totals over a range
partitioning.  A pass over those counts finds the best split of every open node of every variable together,
as a split at a value is decided by the totals before it; only one candidate per node
leaves a task.  Nodes hold at least ``min_size`` of their variable's rows, so a level has at most
``1 / min_size`` of them, and the tree itself stays on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import constants
from scorelake.functions.ordered import running_totals

NODE_SCHEMA = "variable string, node int, low double, high double, good_before long, bad_before long, good long, bad long, min_rows double"


def _purity(good: Column, bad: Column) -> Column:
    """Rows times (1 - Gini impurity): what a split adds to this sum is its gain, in rows."""
    return (good * good + bad * bad).cast("double") / (good + bad)


class _Tree:
    """One variable's tree: nodes are value ranges ``[low, high)`` named by their order of discovery."""

    def __init__(self, good: int, bad: int, min_rows: float):
        self.ranges = [(None, None, 0, 0, good, bad)]
        self.splits: dict[int, tuple[float, float, int, int]] = {}  # node: gain, value, left, right
        self.open = [0] if good and bad and good + bad >= 2 * min_rows else []
        self.min_rows = min_rows

    def close(self, found: dict[int, tuple[float, float, int, int]]) -> None:
        """Take the best splits of the open nodes; their children that can be split are open next."""
        opened = []
        for node in self.open:
            if node not in found:
                continue
            gain, value, left_good, left_bad = found[node]
            low, high, g0, b0, good, bad = self.ranges[node]
            first = len(self.ranges)
            self.ranges += [(low, value, g0, b0, left_good, left_bad), (value, high, g0 + left_good, b0 + left_bad, good - left_good, bad - left_bad)]
            self.splits[node] = (gain, value, first, first + 1)
            opened += [n for n in (first, first + 1) if self.ranges[n][4] and self.ranges[n][5] and sum(self.ranges[n][4:]) >= 2 * self.min_rows]
        self.open = opened

    def chosen(self, leaves: int) -> tuple[list[float], bool]:
        """Breaks of the best-first tree, and whether no open node could still be among them."""
        breaks, waiting = [], [(-self.splits[0][0], 0)] if 0 in self.splits else []
        done = 0 not in self.open
        while waiting and len(breaks) < leaves - 1 and done:
            _, node = heapq.heappop(waiting)
            _, value, *children = self.splits[node]
            breaks.append(value)
            if len(breaks) < leaves - 1 and set(children) & set(self.open):
                done = False
            for child in children:
                if child in self.splits:
                    heapq.heappush(waiting, (-self.splits[child][0], child))
        return sorted(breaks), done


def _best_splits(totals: DataFrame, trees: dict[str, _Tree]) -> dict[str, dict[int, tuple]]:
    nodes = [(v, n, *t.ranges[n], float(t.min_rows)) for v, t in trees.items() for n in t.open]
    # At most 1 / min_size nodes a variable.
    table = F.broadcast(constants(totals, nodes, NODE_SCHEMA).withColumnRenamed("variable", "of"))
    left_good, left_bad = F.col("before_good_count") - F.col("good_before"), F.col("before_bad_count") - F.col("bad_before")
    right_good, right_bad = F.col("good") - left_good, F.col("bad") - left_bad
    inside = (F.col("variable") == F.col("of")) & (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") < F.col("high")))
    placed = totals.join(table, inside).select("variable", "node", "value", "min_rows", left_good.alias("lg"), left_bad.alias("lb"), right_good.alias("rg"), right_bad.alias("rb"))
    valid = placed.filter((F.col("lg") + F.col("lb") >= F.col("min_rows")) & (F.col("rg") + F.col("rb") >= F.col("min_rows")))
    gain = _purity(F.col("lg"), F.col("lb")) + _purity(F.col("rg"), F.col("rb")) - _purity(F.col("lg") + F.col("rg"), F.col("lb") + F.col("rb"))
    best = valid.groupBy("variable", "node").agg(F.max(F.struct(F.round(gain, 6).alias("gain"), (-F.col("value")).alias("back"), "lg", "lb")).alias("best"))
    found: dict[str, dict[int, tuple]] = {}
    for r in best.filter("best.gain > 0").collect():
        found.setdefault(r.variable, {})[r.node] = (r.best.gain, -r.best.back, r.best.lg, r.best.lb)
    return found


def cart_breaks(counts: DataFrame, *, leaves: int, min_size: float) -> tuple[DataFrame, dict[str, list[float]]]:
    """Pre-bins of ``counts (variable, value, row_count, good_count, bad_count)`` by best-first Gini splits.

    Returns ``(variable, position, row_count, good_count, bad_count)`` and each variable's ascending breaks, which
    lie halfway between neighbouring values; a value on a break belongs above it.  Values are finite; equal gains (to 1e-6 rows) go to the
    smaller value, splits without gain are not made.
    """
    totals = running_totals(counts, "value", ["good_count", "bad_count"], ["variable"]).persist()
    try:
        trees = {
            r.variable: _Tree(r.g, r.b, max(1.0, min_size * r.n))
            for r in counts.groupBy("variable").agg(F.sum("good_count").alias("g"), F.sum("bad_count").alias("b"), F.sum("row_count").alias("n")).collect()
        }
        breaks: dict[str, list[float]] = {v: [] for v in trees}
        growing = dict(trees)
        while growing := {v: t for v, t in growing.items() if t.open and not t.chosen(leaves)[1]}:
            found = _best_splits(totals, growing)
            for v, tree in growing.items():
                tree.close(found.get(v, {}))
        for v, tree in trees.items():
            breaks[v] = tree.chosen(leaves)[0]
        listed = F.broadcast(constants(counts, [(v, b) for v, b in breaks.items()], "of string, breaks array<double>"))
        position = F.expr("size(filter(breaks, b -> b <= value))").alias("position")
        cells = (
            totals.join(listed, F.col("variable") == F.col("of"))
            .groupBy("variable", position)
            .agg(*[F.sum(c).alias(c) for c in ("row_count", "good_count", "bad_count")], F.max("value").alias("highest"))
        )
        rows = cells.collect()  # one row per pre-bin
    finally:
        totals.unpersist()
    below = {(r.variable, r.position): r.highest for r in rows}
    middle = {v: [(below[v, i] + b) / 2 if below[v, i] < (below[v, i] + b) / 2 else b for i, b in enumerate(bs)] for v, bs in breaks.items()}
    schema = "variable string, position int, row_count long, good_count long, bad_count long"
    return constants(counts, [(r.variable, r.position, r.row_count, r.good_count, r.bad_count) for r in rows], schema), middle
