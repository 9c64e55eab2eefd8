"""Class weights, stratified folds, refitted search and tree facts."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import ordered
from scorelake.functions.target import TargetSpec
from scorelake.operators import metrics, model

TARGET = TargetSpec("outcome", good=("good",), bad=("bad",))


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.range(600).select(
        "id",
        (F.col("id") % 13).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        F.when((F.col("id") % 13 > 9) & (F.col("id") % 3 == 0), "bad").otherwise("good").alias("outcome"),
    )
    return rows.cache()


def test_balanced_weights_raise_the_rare_class(sample):
    plain = model.apply_tree(model.fit_tree(sample, TARGET, ["a", "b"], "decision_tree", max_depth=2), sample, ["a", "b"])
    for kind in ("decision_tree", "random_forest"):
        fitted = model.fit_tree(sample, TARGET, ["a", "b"], kind, class_weight="balanced", max_depth=2)
        weighted = model.apply_tree(fitted, sample, ["a", "b"])
        mean = lambda df: df.agg(F.avg(metrics.PROBABILITY)).first()[0]
        assert mean(weighted) > mean(plain) + 0.1
    data = model.class_weights(model.assembled(sample, ["a"], TARGET), "balanced")
    sums = [r[1] for r in data.groupBy("label").agg(F.sum(model.CLASS_WEIGHT)).collect()]
    assert sums[0] == pytest.approx(300) and sums[1] == pytest.approx(300)


def test_folds_are_even_within_each_class(sample):
    folded = model.with_folds(sample, ["id"], 5, by=TARGET.is_bad)
    counts = {}
    for r in folded.groupBy("outcome", "fold").count().collect():
        counts.setdefault(r.outcome, []).append(r["count"])
    assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in counts.values())


def test_search_returns_the_refitted_best_model(sample):
    table, best = model.tune_best(sample, TARGET, ["a", "b"], ["id"], "decision_tree", {"max_depth": [1, 4]}, folds=3)
    first = table.orderBy("rank").first()
    assert first.params == f"maxDepth={best.getMaxDepth()}" and best.numFeatures == 2


def test_tree_facts_and_blank_members(sample):
    shallow = model.fit_tree(sample, TARGET, ["a", "b"], "decision_tree", class_weight="balanced", max_depth=1)
    assert model.tree_facts(sample, shallow).first() == (1, 2, "FULL_DEPTH_TREE")
    deep = model.fit_tree(sample, TARGET, ["a"], "decision_tree", max_depth=9)
    assert model.tree_facts(sample, deep).first().warning is None
    with pytest.raises(ValueError):
        TargetSpec("outcome", good=("good", ""), bad=("bad",))


def test_search_counts_its_tests_only_and_in_bounded_slices(spark, monkeypatch):
    rows = spark.range(900).select("id", (F.col("id") * 7 % 101).cast("double").alias("a"), F.when(F.col("id") * 13 % 10 < F.col("id") % 101 / 20, "bad").otherwise("good").alias("outcome"))
    target = TargetSpec("outcome", good=("good",), bad=("bad",))
    told = lambda: (
        model.tune(rows, target, ["a"], ["id"], "logistic", {"c": [0.1, 1.0]}, folds=3).collect(),
        sorted(model.cross_validate(rows, target, ["a"], ["id"], "logistic", folds=3).collect()),
    )
    whole, seen = told(), []
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    real = model.scored_counts
    monkeypatch.setattr(model, "scored_counts", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    assert told() == whole
    assert [c.rdd.getNumPartitions() for c in seen] == [18, 27]
    assert [sorted(r.role for r in c.select("role").distinct().collect()) for c in seen] == [["test"], ["test", "train"]]
