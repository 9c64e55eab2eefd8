import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions.special import _upper_gamma
from scorelake.functions.target import TargetSpec
from scorelake.operators import calibrate, explain, fairness, metrics, model, prep, reject, scaling, strategy

TARGET = TargetSpec("target", ("good",), ("bad",), ("maybe",))


def _scored(spark, n=900, seed=1, partitions=4):
    rng = np.random.default_rng(seed)
    p = rng.random(n).round(2)
    rows = [
        (["train", "test", "oot"][i % 3], float(v), float(round(600 - 100 * v, 1)), "maybe" if i % 50 == 0 else ("bad" if rng.random() < v else "good"), i)
        for i, v in enumerate(p)
    ]
    return spark.createDataFrame(rows, "role string, predicted_bad_probability double, score double, target string, id long").repartition(partitions)


def _auc(p, y):
    bad, good = p[y == 1], p[y == 0]
    return ((bad[:, None] > good[None, :]).sum() + 0.5 * (bad[:, None] == good[None, :]).sum()) / (len(bad) * len(good))


@pytest.mark.parametrize("partitions", [1, 16])
def test_auc_and_ks_equal_brute_force(spark, partitions):
    df = _scored(spark, partitions=partitions)
    local = df.toPandas()
    local = local[local.target != "maybe"]
    auc = {r.role: r for r in metrics.auc_gini(metrics.score_ranking(df, TARGET, metrics.PROBABILITY)).collect()}
    flipped = df.withColumn(metrics.PROBABILITY, -F.col(metrics.PROBABILITY))
    other = {r.role: r.auc for r in metrics.auc_gini(metrics.score_ranking(flipped, TARGET, metrics.PROBABILITY)).collect()}
    ks = {r.role: r.ks for r in metrics.ks(metrics.score_ranking(df, TARGET, metrics.SCORE)).collect()}
    for role, part in local.groupby("role"):
        y = (part.target == "bad").to_numpy().astype(int)
        assert auc[role].auc == pytest.approx(_auc(part.predicted_bad_probability.to_numpy(), y), abs=1e-6)
        assert other[role] == pytest.approx(1 - auc[role].auc, abs=2e-6)
        s = part.score.to_numpy()
        gaps = [abs((s[y == 0] <= v).mean() - (s[y == 1] <= v).mean()) for v in np.unique(s)]
        assert ks[role] == pytest.approx(max(gaps), abs=1e-6)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([("train", 0.2, "good"), ("train", 0.4, "good")], "role string, predicted_bad_probability double, target string")
    assert metrics.auc_gini(metrics.score_ranking(df, TARGET, metrics.PROBABILITY)).first().auc is None
    assert metrics.target_availability(df, TARGET).first().status == "SINGLE_CLASS_ONLY_GOOD"


def test_psi_of_equal_samples_is_zero(spark):
    df = _scored(spark).filter("role = 'train'")
    both = df.unionByName(df.withColumn("role", F.lit("test")))
    assert metrics.psi(both, TARGET).first().psi == 0.0
    flat = both.withColumn("score", F.lit(500.0))
    assert metrics.psi(flat, TARGET).first().psi == 0.0


def test_psi_floors_empty_bins(spark):
    rows = [("train", float(i), "good") for i in range(100)] + [("test", 99.5, "good")] * 10
    row = metrics.psi(spark.createDataFrame(rows, "role string, score double, target string"), TARGET).first()
    terms = [(0.05 - 0.1) * np.log(0.05 / 0.1)] * 9 + [(1.0 - 0.1) * np.log(1.0 / 0.1)]
    assert row.psi == pytest.approx(sum(terms), abs=1e-6) and row.empty_bins == 9


def test_chi_square_tail_known_values():
    for statistic, degrees, expected in ((3.841458821, 1, 0.05), (15.50731306, 8, 0.05), (2.0, 2, np.exp(-1.0)), (0.0, 4, 1.0)):
        assert _upper_gamma(degrees / 2, statistic / 2) == pytest.approx(expected, abs=1e-8)


def test_hosmer_lemeshow_never_splits_ties(spark):
    rows = [("train", 0.1, "good")] * 18 + [("train", 0.1, "bad")] * 2 + [("train", 0.9, "bad")] * 18 + [("train", 0.9, "good")] * 2
    row = metrics.hosmer_lemeshow(spark.createDataFrame(rows, "role string, predicted_bad_probability double, target string"), TARGET).first()
    assert (row.known_count, row.n_bins, row.degrees_of_freedom) == (40, 2, 1)
    assert row.statistic == 0.0 and row.p_value == 1.0


def test_bands_keep_every_row_and_empty_bands(spark):
    df = _scored(spark)
    for bands in (strategy.cutoff_bands(df, TARGET), strategy.cutoff_bands(df, TARGET, cutoffs=[0, 550, 1000])):
        sums = {r.role: r.n for r in bands.groupBy("role").agg(F.sum("count").alias("n")).collect()}
        assert sums == {"train": 300, "test": 300, "oot": 300}
    assert strategy.cutoff_bands(df, TARGET, cutoffs=[0, 550, 1000]).filter("count = 0").count() == 6
    with pytest.raises(ValueError):
        strategy.cutoff_bands(df.withColumn("score", F.lit(1.0)), TARGET)


@pytest.mark.parametrize("objective", strategy.OBJECTIVES)
def test_threshold_search_equals_brute_force(spark, objective):
    df = _scored(spark)
    local = df.toPandas()
    local = local[local.target != "maybe"]
    for r in strategy.optimise_threshold(df, TARGET, objective, n_thresholds=41).collect():
        part = local[local.role == r.role]
        y, p = (part.target == "bad").to_numpy(), part.predicted_bad_probability.to_numpy()
        values = []
        for t in np.linspace(0, 1, 41):
            tp, fp = (y & (p >= t)).sum(), (~y & (p >= t)).sum()
            fn, tn = y.sum() - tp, (~y).sum() - fp
            recall, spec, prec = tp / (tp + fn), tn / (tn + fp), tp / (tp + fp) if tp + fp else 0.0
            f1 = 2 * prec * recall / (prec + recall) if prec + recall else 0.0
            values.append({"youden": recall + spec - 1, "max_f1": f1, "max_g_mean": (recall * spec) ** 0.5, "cost_minimize": -(fp + 10.0 * fn)}[objective])
        assert r.objective_value == pytest.approx(max(values), abs=1e-6)
        assert r.threshold == pytest.approx(np.linspace(0, 1, 41)[int(np.argmax(values))], abs=1e-6)
        assert r.selected == (r.role == "test")


def test_fairness_suppresses_small_groups(spark):
    rows = [("train", "a", 0.1, 700.0, "good")] * 5 + [("train", "b", 0.9, 500.0, "bad")] * 5 + [("train", "c", 0.9, 500.0, "bad")]
    df = spark.createDataFrame(rows, "role string, segment string, predicted_bad_probability double, score double, target string")
    groups = fairness.fairness_groups(df, TARGET, "segment", min_group=5)
    got = {r.group: r for r in groups.collect()}
    assert (got["a"].approval_rate, got["b"].approval_rate, got["a"].score_median) == (1.0, 0.0, 700.0)
    assert got["c"].status == "insufficient_evidence" and got["c"].approval_rate is None
    parity = fairness.fairness_parity(groups).first()
    assert (parity.group_count, parity.max_approval_rate_difference, parity.max_bad_rate_difference) == (2, 1.0, 1.0)


def test_proxy_risk_levels(spark):
    df = spark.range(50).selectExpr("cast(id AS double) AS age", "cast(id AS double) * 2 AS tenure", "cast(id % 2 AS double) AS parity")
    rows = fairness.proxy_risk(df, ["age", "parity"], ["tenure"], {"parity": 0.5}).collect()
    assert {r.sensitive_column: r.risk_level for r in rows} == {"age": "high", "parity": "medium"}


def test_platt_calibration_and_folding(spark):
    rows = [(0.1, "good")] * 20 + [(0.1, "bad")] * 5 + [(0.9, "bad")] * 20 + [(0.9, "good")] * 5
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "predicted_bad_probability double, target string, id long")
    fitted = calibrate.fit_platt(df, TARGET)
    assert fitted.parts[0][0] > 0 and fitted.parts[0][1] == pytest.approx(0.0, abs=1e-4)
    table = scaling.coefficients_table(df, 0.5, {"a_woe": -1.0})
    slope, shift = fitted.parts[0]
    folded = {r.feature: r.coefficient for r in fitted.fold_into(table).collect()}
    assert folded["a_woe"] == pytest.approx(-slope, abs=1e-6) and folded["(Intercept)"] == pytest.approx(0.5 * slope + shift, abs=1e-6)
    assert calibrate.fit_platt(df.limit(10), TARGET).parts == ()
    with pytest.raises(ValueError):
        calibrate.fit_platt(df.withColumn("predicted_bad_probability", 1 - F.col("predicted_bad_probability")), TARGET)
    assert len(calibrate.fit_platt(df, TARGET, folds=3, keys=["id"]).parts) == 3
    steps = calibrate.fit_isotonic(df, TARGET).transform(df.limit(1).withColumn("predicted_bad_probability", F.lit(0.99)))
    assert steps.first().predicted_bad_probability == pytest.approx(0.8)


def _population(spark):
    df = spark.range(600).selectExpr(
        "id", "cast(id % 40 AS double) AS x", "cast(id % 7 AS double) AS w",
        "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 40 > 25 THEN 'bad' WHEN id % 11 = 0 THEN 'bad' ELSE 'good' END AS target",
    )
    return prep.classify_population(df, TARGET, prep.RejectRules("ttd", "target_missing"))


def test_augmentation_draws_by_band_weight(spark):
    population = _population(spark)
    params = reject.AugmentationParams(bands=4)
    drawn = reject.augment(population, TARGET, ["id"], ["x", "w"], params)
    assert drawn.count() == 480 and prep.FINANCED not in drawn.columns
    assert drawn.filter("target IS NULL").count() == 0
    bands = reject.band_weights(reject.score_bands(population, TARGET, ["x", "w"], params), TARGET, params).collect()
    assert sum(r.n_total for r in bands) == 600 and all(r.weight == pytest.approx(r.n_total / r.n_financed) for r in bands)
    kept = population.filter(prep.FINANCED)
    assert sorted(reject.augment(kept, TARGET, ["id"]).columns) == sorted(c for c in kept.columns if c != prep.FINANCED)


def test_tree_rules_and_explanations(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 20 AS double) AS a", "cast(id % 3 AS double) AS b", "CASE WHEN id % 20 > 9 THEN 'bad' ELSE 'good' END AS target")
    fitted = model.fit_tree(df, TARGET, ["a", "b"], "decision_tree", max_depth=3)
    rules = model.tree_rules(df, fitted, TARGET, ["a", "b"]).orderBy("rule_id").collect()
    assert [(r.rule, r.probability, r.sample_count) for r in rules] == [("a <= 9.5", 0.0, 200), ("a > 9.5", 1.0, 200)]
    losses = {r.feature: r.importance_mean for r in explain.permutation_importance(df, fitted, TARGET, ["a", "b"], ["id"], repeats=2).collect()}
    assert losses["a"] > 0.3 and losses["b"] == 0.0
    table = model.importances(df, fitted, ["a", "b"])
    shape = explain.partial_dependence(df, fitted, ["a", "b"], table, top=1).orderBy("grid_value").collect()
    assert [r.average_prediction for r in shape] == [0.0] * 10 + [1.0] * 10
    cv = model.cross_validate(df, TARGET, ["a", "b"], ["id"], "decision_tree", folds=2)
    assert {r.auc for r in cv.collect()} == {1.0}
    best = model.tune(df, TARGET, ["a", "b"], ["id"], "decision_tree", {"max_depth": [1, 2]}, folds=2)
    assert best.filter("rank = 1").first().mean_auc == 1.0


def test_boosted_models_score_probabilities(spark):
    df = spark.range(200).selectExpr("cast(id % 10 AS double) AS a", "CASE WHEN id % 10 > 4 THEN 'bad' ELSE 'good' END AS target")
    for kind in ("gradient_boosting", "lightgbm", "random_forest"):
        fitted = model.fit_tree(df, TARGET, ["a"], kind, n_trees=3)
        p = model.apply_tree(fitted, df, ["a"]).groupBy("target").agg(F.avg(metrics.PROBABILITY).alias("p")).collect()
        assert {r.target: r.p > 0.5 for r in p} == {"bad": True, "good": False}


def test_importance_stability(spark):
    rows = [(s, f, v) for s in (1, 2) for f, v in (("a", 3.0), ("b", 2.0), ("c", 1.0))]
    same = explain.importance_stability(spark.createDataFrame(rows, "seed int, feature string, importance double")).first()
    assert same.mean_rank_correlation == 1.0 and not same.top_features_changed
