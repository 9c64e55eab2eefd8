"""Stored trees as tables, and what follows from their nodes: rules and partial dependence.

A fitted model is written to the shared folder and its node table is read back; it is fitted state,
of a size set by depth and number of trees, not by rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.columns import quote, sql_number
from scorelake.functions.state import staging_path
from scorelake.operators.scaling import INTERCEPT, model_of

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """``(tree, node, left, right, feature, threshold, prediction, stats)``; leaves have no children."""
    path = staging_path(spark)
    model.save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" in stored.columns:
        stored = stored.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        stored = stored.withColumn("tree", F.lit(0))
    leaf = F.col("leftChild") < 0
    child = lambda c: F.when(~leaf, F.col(c))
    return stored.select(
        "tree", F.col("id").alias("node"), child("leftChild").alias("left"), child("rightChild").alias("right"),
        child("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        "prediction", F.col("impurityStats").alias("stats"), (F.col("split.numCategories") >= 0).alias("categorical"),
    )


TREE_MODELS = (DecisionTreeClassificationModel, RandomForestClassificationModel, GBTClassificationModel)


@dataclass(frozen=True)
class Forest:
    """Node arrays of every tree, the leaf values they add up, and what the sum becomes."""

    trees: tuple[tuple[np.ndarray, ...], ...]  # left, right, feature, threshold, value; a left below 0 is a leaf
    boosted: bool

    def finish(self, total: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-2.0 * total)) if self.boosted else total


def forest_of(spark: SparkSession, model) -> Forest:
    """The bad-class probability of a decision tree, a random forest or boosted trees as arrays."""
    if not isinstance(model, TREE_MODELS):
        raise ValueError("the model has no trees")
    boosted = isinstance(model, GBTClassificationModel)
    weights = [1.0] if isinstance(model, DecisionTreeClassificationModel) else list(model.treeWeights)
    scale = 1.0 if boosted else sum(weights)
    found: dict[int, list] = {}
    for r in tree_nodes(spark, model).collect():  # fitted state
        if r.categorical:
            raise ValueError("categorical splits are not supported")
        found.setdefault(r.tree, []).append(r)
    trees = []
    for tree, rows in sorted(found.items()):
        rows.sort(key=lambda r: r.node)
        value = lambda r: r.prediction if boosted else r.stats[1] / sum(r.stats)
        trees.append(
            (
                np.array([-1 if r.left is None else r.left for r in rows]), np.array([-1 if r.right is None else r.right for r in rows]),
                np.array([-1 if r.feature is None else r.feature for r in rows]), np.array([r.threshold if r.left is not None else 0.0 for r in rows]),
                np.array([value(r) for r in rows]) * weights[tree] / scale,
            )
        )
    return Forest(tuple(trees), boosted)


def probability_sql(spark: SparkSession, model, features: Sequence[str]) -> str:
    """The bad-class probability of a decision tree as Spark SQL over features that are not missing."""
    ((left, right, feature, threshold, value),) = forest_of(spark, model).trees

    def node(i: int) -> str:
        if left[i] < 0:
            return sql_number(value[i])
        return f"if(cast({quote(features[feature[i]])} AS double) <= {sql_number(threshold[i])}, {node(left[i])}, {node(right[i])})"

    return node(0)


def probabilities(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The bad-class probability of every row of ``x``."""
    total = np.zeros(len(x))
    for left, right, feature, threshold, value in forest.trees:
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if left[node] < 0:
                total[rows] += value[node]
            elif len(rows):
                below = x[rows, feature[node]] <= threshold[node]
                waiting += [(left[node], rows[below]), (right[node], rows[~below])]
    return forest.finish(total)


def leaf_rules(spark: SparkSession, model, features: Sequence[str]) -> list[tuple[int, str]]:
    """Conditions of each leaf of a decision tree, leaves numbered from the left as the model numbers them; TRUE for a lone leaf."""
    ((left, right, feature, threshold, _),) = forest_of(spark, model).trees
    rules: list[tuple[int, str]] = []

    def walk(node: int, path: tuple[str, ...]) -> None:
        if left[node] < 0:
            rules.append((len(rules), " AND ".join(path) or "TRUE"))
            return
        name, cut = features[feature[node]], round(float(threshold[node]), 6)
        walk(left[node], (*path, f"{name} <= {cut}"))
        walk(right[node], (*path, f"{name} > {cut}"))

    walk(0, ())
    return rules


def _tree_curves(forest: Forest, j: int, grid: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums over rows of the probability with feature j set to each grid value.

    A split on j parts the grid, any other split parts the rows, so each row meets each tree's leaves at most once a grid range.
    """

    def curve(x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(grid)))
        for left, right, feature, threshold, value in forest.trees:
            waiting = [(0, np.arange(len(x)), 0, len(grid))]
            while waiting:
                node, rows, low, high = waiting.pop()
                if not len(rows) or low == high:
                    continue
                if left[node] < 0:
                    total[rows, low:high] += value[node]
                elif feature[node] == j:
                    cut = min(max(int(np.searchsorted(grid, threshold[node], side="right")), low), high)
                    waiting += [(left[node], rows, low, cut), (right[node], rows, cut, high)]
                else:
                    below = x[rows, feature[node]] <= threshold[node]
                    waiting += [(left[node], rows[below], low, high), (right[node], rows[~below], low, high)]
        return forest.finish(total).sum(axis=0)

    return curve


def _linear_curves(slopes: np.ndarray, intercept: float, j: int, grid: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The same for a logistic model: only one term of the log-odds changes."""

    def curve(x: np.ndarray) -> np.ndarray:
        rest = intercept + x @ slopes - x[:, j] * slopes[j]
        return (1.0 / (1.0 + np.exp(-(rest[:, None] + grid[None, :] * slopes[j])))).sum(axis=0)

    return curve


ROWS = 4096  # rows whose curves are computed together


def dependence(rows: DataFrame, model, features: Sequence[str], grids: dict[str, Sequence[float]]) -> DataFrame:
    """``(feature, place, average)``: mean probability of all rows at each grid value, for all features in one pass.

    ``rows`` has ``x``, the feature values in order; ``model`` is a tree model or a coefficient table.  No row is copied for a
    grid value: a task returns one sum per feature and grid value.
    """
    names = list(features)
    if isinstance(model, DataFrame):
        intercept, slopes = model_of(model)
        w = np.array([slopes.get(f, 0.0) for f in names])
        curves = {f: _linear_curves(w, intercept, names.index(f), np.array(g)) for f, g in grids.items()}
    else:
        forest = forest_of(rows.sparkSession, model)
        curves = {f: _tree_curves(forest, names.index(f), np.array(g)) for f, g in grids.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = {f: 0.0 for f in curves}, 0
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for start in range(0, len(x), ROWS):
                for f, curve in curves.items():
                    sums[f] = sums[f] + curve(x[start : start + ROWS])
            n += len(x)
        for f, total in sums.items() if n else ():
            place = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(total)), pa.array(place), pa.array(total), pa.array(np.full(len(total), n))], names=["feature", "place", "total", "n"])

    made = rows.select("x").mapInArrow(add, "feature string, place int, total double, n long")
    return made.groupBy("feature", "place").agg((F.sum("total") / F.sum("n")).alias("average"))
