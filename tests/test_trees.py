"""Rules and partial dependence from stored trees against the model itself."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorelake.functions.target import TargetSpec
from scorelake.operators import explain, metrics, model, scaling, trees

TARGET = TargetSpec("outcome", good=("good",), bad=("bad",))
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample(spark):
    bad = (F.col("id") % 13 > 7) & (F.col("id") % 3 == 0) | (F.col("id") % 31 == 4)
    rows = spark.range(500).select("id", *[(F.col("id") * m % n).cast("double").alias(f) for f, m, n in (("a", 1, 13), ("b", 5, 7), ("c", 3, 101))])
    return rows.withColumn("outcome", F.when(bad, "bad").otherwise("good")).repartition(3).cache()


@pytest.mark.parametrize("kind", ["decision_tree", "random_forest", "gradient_boosting"])
def test_dependence_equals_rescoring(sample, kind):
    params = {} if kind == "decision_tree" else {"n_trees": 4}
    fitted = model.fit_tree(sample, TARGET, FEATURES, kind, max_depth=3, **params)
    grids = {"a": [0.0, 4.5, 8.0, 99.0], "c": [-1.0, 33.3, 50.0]}
    rows = model.assembled(sample, FEATURES).select(vector_to_array("features").alias("x"))
    got = {(r.feature, r.place): r.average for r in trees.dependence(rows, fitted, FEATURES, grids).collect()}
    for f, grid in grids.items():
        for k, g in enumerate(grid):
            again = model.apply_tree(fitted, sample.withColumn(f, F.lit(g)), FEATURES).agg(F.avg(metrics.PROBABILITY)).first()[0]
            assert got[f, k] == pytest.approx(again, abs=1e-12)


def test_dependence_of_a_coefficient_table(sample):
    linear = scaling.coefficients_table(sample, -1.0, {"a": 0.2, "c": -0.01})
    rows = model.assembled(sample, FEATURES).select(vector_to_array("features").alias("x"))
    (got,) = trees.dependence(rows, linear, FEATURES, {"a": [3.0]}).collect()
    z = F.lit(-1.0) + F.lit(0.6) - F.lit(0.01) * F.col("c")
    assert got.average == pytest.approx(sample.agg(F.avg(1 / (1 + F.exp(-z)))).first()[0])


def test_rules_are_filters_for_their_leaves(spark, sample):
    fitted = model.fit_tree(sample, TARGET, FEATURES, "decision_tree", max_depth=4)
    rules = trees.leaf_rules(spark, fitted, FEATURES)
    assert len(rules) == (fitted.numNodes + 1) // 2
    placed = fitted.transform(model.assembled(sample, FEATURES, keep=["id"])).select("id", F.col("leaf").cast("int").alias("leaf"))
    for leaf, rule in rules:
        assert {r.id for r in sample.filter(rule).collect()} == {r.id for r in placed.filter(F.col("leaf") == leaf).collect()}
    with pytest.raises(ValueError, match="no trees"):
        trees.forest_of(spark, object())


def test_boosted_trees_of_cells_are_those_of_the_rows(sample):
    by_rows, none = model.fit_boosted(sample, TARGET, FEATURES, n_trees=5, max_depth=3)
    by_cells, points = model.fit_boosted(sample, TARGET, FEATURES, celled_rows=0, n_trees=5, max_depth=3)
    assert none is None and [len(p) for p in points] == [12, 6, 31]
    assert list(by_cells.featureImportances.toArray()) == pytest.approx(list(by_rows.featureImportances.toArray()), abs=1e-9)
    told = lambda fitted, rows: {r.id: r[metrics.PROBABILITY] for r in model.apply_tree(fitted, rows, FEATURES).collect()}
    assert told(by_cells, model.in_bins(sample, FEATURES, points)) == pytest.approx(told(by_rows, sample), abs=1e-9)


def test_rows_of_boosted_cells_are_bounded_by_the_bins(spark, monkeypatch):
    seen = []

    class Fake:
        def setWeightCol(self, _):
            return self

        def fit(self, data):
            seen.append(data.count())

    rows = spark.range(5000).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "bad").otherwise("good").alias("outcome"))
    monkeypatch.setattr(model, "tree_estimator", lambda *_, **__: Fake())
    model.fit_boosted(rows, TARGET, ["a"], celled_rows=100)
    assert seen == [14]


def test_tasks_of_a_forest_hold_a_bounded_number_of_rows(sample, monkeypatch):
    seen = []

    class Fake:
        def getNumTrees(self):
            return 10

        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())

    monkeypatch.setattr(model, "tree_estimator", lambda *_, **__: Fake())
    monkeypatch.setattr(model, "FOREST_NUMBERS", 500)
    model.fit_tree(sample, TARGET, FEATURES, "random_forest")
    assert seen == [10]


def test_a_tree_scores_as_spark_does_and_refuses_missing_features(sample):
    fitted = model.fit_tree(sample, TARGET, FEATURES, "decision_tree", max_depth=4)
    told = fitted.transform(model.assembled(sample, FEATURES, keep=["id"])).select("id", vector_to_array("probability")[1].alias("p")).collect()
    again = model.apply_tree(fitted, sample, FEATURES)
    assert {r.id: r[metrics.PROBABILITY] for r in again.collect()} == {r.id: r.p for r in told}
    for gone in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="missing"):
            model.apply_tree(fitted, sample.withColumn("b", gone), FEATURES).collect()


@pytest.mark.parametrize("kind", ["decision_tree", "random_forest", "gradient_boosting"])
def test_permutations_counted_in_batches_equal_scored_rows(sample, monkeypatch, kind):
    params = {} if kind == "decision_tree" else {"n_trees": 3}
    fitted = model.fit_tree(sample, TARGET, FEATURES, kind, max_depth=3, **params)
    told = lambda: {tuple(r) for r in explain.permutation_importance(sample, fitted, TARGET, FEATURES, ["id"], repeats=2).collect()}
    calls = []
    monkeypatch.setattr(explain, "forest_of", lambda *a: calls.append(1) or trees.forest_of(*a))
    batches = told()
    monkeypatch.setattr(explain, "TREE_MODELS", ())
    assert batches == told() and calls == [1]
