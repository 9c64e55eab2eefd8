"""Logistic and tree models on Spark ML, cross-validation and search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col, constants, numeric_columns, quote, ratio, sql_search
from scorelake.functions.hashing import dense_index, hash_order, lean_index
from scorelake.functions.ordered import running_totals, slices_for
from scorelake.functions.state import stage
from scorelake.functions.target import TargetSpec
from scorelake.operators.metrics import PROBABILITY, auc_gini
from scorelake.operators.newton import Fit, fit_many, scored_counts, slices_won
from scorelake.operators.scaling import coefficients_table
from scorelake.operators.trees import leaf_rules, probability_sql


def feature_columns(
    df: DataFrame, target: str, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> list[str]:
    """Numeric columns that are neither the target nor internal (``_`` prefix)."""
    if include:
        missing = [c for c in include if c not in df.columns]
        if missing:
            raise ValueError(f"feature columns not found: {missing}")
        chosen = list(include)
    else:
        chosen = [c for c in numeric_columns(df) if c != target and not c.startswith("_")]
    kept = [c for c in chosen if c not in set(exclude)]
    if not kept:
        raise ValueError("no feature columns left")
    return kept


def assembled(df: DataFrame, features: Sequence[str], target: TargetSpec | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``(features, label, keep...)``; a null feature is an error, as for any matrix fit."""
    doubles = {f: col(f).cast("double") for f in features}
    wide = df.withColumns(doubles)
    if target is not None:
        wide = wide.filter(target.is_known).withColumn("label", F.when(target.is_bad, 1.0).otherwise(0.0))
        keep = [*keep, "label"]
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return vector.transform(wide).select("features", *[col(k) for k in keep])


# --- logistic regression ---------------------------------------------------------


@dataclass(frozen=True)
class LogisticParams:
    """``c`` is the inverse penalty on the summed loss, as in the C form."""

    penalty: str | None = "l2"
    c: float = 1.0
    l1_ratio: float = 0.5
    max_iter: int = 1000
    tolerance: float = 1e-9
    fail_on_no_convergence: bool = True

    def fit(self, without: int | None = None) -> Fit:
        """The penalties of one of many fits that share their passes."""
        share = {"l2": 0.0, "l1": 1.0, "elasticnet": self.l1_ratio}.get(self.penalty, 0.0)
        strength = 0.0 if self.penalty in (None, "none") else 1.0 / self.c
        return Fit(l2=strength * (1.0 - share), l1=strength * share, without=without)

    def estimator(self, n: int) -> LogisticRegression:
        mixing = {"l2": 0.0, "l1": 1.0, "elasticnet": self.l1_ratio, None: 0.0, "none": 0.0}[self.penalty]
        strength = 0.0 if self.penalty in (None, "none") else 1.0 / (self.c * max(n, 1))
        return LogisticRegression(
            regParam=strength, elasticNetParam=mixing, maxIter=self.max_iter, tol=self.tolerance, standardization=False
        )


def fit_logistic(
    df: DataFrame, target: TargetSpec, features: Sequence[str] | None = None, params: LogisticParams = LogisticParams()
) -> DataFrame:
    """Coefficient table (six decimals) of a logistic model, by default on all WOE columns."""
    features = list(features or [c for c in df.columns if c.endswith("_woe")])
    if not features:
        raise ValueError("no WOE columns to fit")
    rows = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(target.is_known, 1)).alias("known")).first()
    if rows.n != rows.known:
        raise ValueError("every row needs a declared good or bad outcome")
    (beta,), (converged,) = fit_many(stage(model_rows(df, target, features)), [params.fit()], params.max_iter)
    if not converged and params.fail_on_no_convergence:
        raise ValueError(f"logistic regression did not converge in {params.max_iter} iterations")
    return _coefficients(df, features, beta)


def model_rows(df: DataFrame, target: TargetSpec, features: Sequence[str], fold: Column | None = None) -> DataFrame:
    """``(x, y, weight, fold)`` of the rows with an outcome; a missing feature is an error, as for any matrix fit."""
    values = [col(f).cast("double") for f in features]
    missing = F.raise_error(F.lit("a feature is missing"))
    x = F.array(*[F.when(v.isNull() | F.isnan(v), missing.cast("double")).otherwise(v) for v in values])
    bad = F.when(target.is_bad, 1.0).otherwise(0.0)
    return df.filter(target.is_known).select(x.alias("x"), bad.alias("y"), F.lit(1.0).alias("weight"), (F.lit(-1) if fold is None else fold).cast("int").alias("fold"))


def _coefficients(df: DataFrame, features: Sequence[str], beta) -> DataFrame:
    return coefficients_table(df, round(float(beta[0]), 6), {f: round(float(v), 6) for f, v in zip(features, beta[1:])})


# --- trees ------------------------------------------------------------------------

# Depth of the three boosting presets, 100 rounds at rate 0.1.
BOOSTING_DEPTH = {"xgboost": 6, "lightgbm": 5, "catboost": 6}


def tree_estimator(kind: str, seed: int = 42, **params):
    """decision_tree, random_forest, gradient_boosting or a boosting preset."""
    common = {"seed": seed, "minInstancesPerNode": params.pop("min_samples_leaf", 1)}
    if kind == "decision_tree":
        return DecisionTreeClassifier(maxDepth=params.pop("max_depth", 5), leafCol="leaf", **common, **params)
    if kind == "random_forest":
        return RandomForestClassifier(
            numTrees=params.pop("n_trees", 100), maxDepth=params.pop("max_depth", 5), **common, **params
        )
    if kind == "gradient_boosting" or kind in BOOSTING_DEPTH:
        depth = params.pop("max_depth", BOOSTING_DEPTH.get(kind, 3))
        return GBTClassifier(
            maxIter=params.pop("n_trees", 100), maxDepth=depth, stepSize=params.pop("learning_rate", 0.1), **common, **params
        )
    raise ValueError(f"unknown tree model {kind!r}")


CLASS_WEIGHT = "_class_weight"


def class_weights(data: DataFrame, weights: str | Mapping[int, float]) -> DataFrame:
    """Add a row weight by label: given per label, or "balanced" (rows / (2 rows of the class))."""
    if isinstance(weights, str):
        if weights != "balanced":
            raise ValueError("class weights are a mapping or 'balanced'")
        counts = {int(r.label): r["count"] for r in data.groupBy("label").count().collect()}
        weights = {label: sum(counts.values()) / (2.0 * n) for label, n in counts.items()}
    value = F.when(F.col("label") == 1, F.lit(float(weights.get(1, 1.0)))).otherwise(F.lit(float(weights.get(0, 1.0))))
    return data.withColumn(CLASS_WEIGHT, value)


def fit_tree(
    df: DataFrame,
    target: TargetSpec,
    features: Sequence[str],
    kind: str,
    seed: int = 42,
    class_weight: str | Mapping[int, float] | None = None,
    **params,
):
    """Fit a tree model; ``class_weight`` weighs rows by their class."""
    data, estimator = assembled(df, features, target), tree_estimator(kind, seed, **params)
    if kind == "random_forest":
        n, rows = data.count(), max(1, FOREST_NUMBERS // estimator.getNumTrees())
        if n > rows * df.sparkSession.sparkContext.defaultParallelism:
            data = data.repartition(-(-n // rows))
    if class_weight is not None:
        data, estimator = class_weights(data, class_weight), estimator.setWeightCol(CLASS_WEIGHT)
    return estimator.fit(data)


# Rows a task of a forest fit holds, each with one number per tree.
FOREST_NUMBERS = 50_000_000
# Boosted trees of more rows than this are fitted on cells; bins a feature has at most, as the estimator's default.
CELLED_ROWS = 1_000_000
MAX_BINS = 32


def split_points(data: DataFrame, features: int, seed: int = 42) -> list[list[float]]:
    """Thresholds of every feature, at most ``MAX_BINS - 1``, by the estimators' own rule and from a sample as large as theirs."""
    wanted, n = max(MAX_BINS**2, 10_000), data.count()
    drawn = data if n <= wanted else data.sample(wanted / n, seed)
    x = np.array([r.x for r in drawn.select(vector_to_array("features").alias("x")).collect()]).reshape(-1, features)
    points = []
    for j in range(features):
        values, counts = np.unique(x[:, j], return_counts=True)
        middles = (values[1:] + values[:-1]) / 2.0
        if len(middles) >= MAX_BINS:
            stride, kept, below = len(x) / MAX_BINS, [], np.cumsum(counts)
            for k in range(len(middles)):
                target = stride * (len(kept) + 1)
                if abs(below[k] - target) < abs(below[k + 1] - target):
                    kept.append(middles[k])
            middles = kept
        points.append([float(m) for m in middles])
    return points


def in_bins(df: DataFrame, features: Sequence[str], points: Sequence[Sequence[float]]) -> DataFrame:
    """Features as the numbers, from 1, of their ``(lo, hi]`` bins; a missing one is an error."""
    missing = F.raise_error(F.lit("a feature is missing")).cast("double")
    placed = {}
    for f, cuts in zip(features, points):
        x = col(f).cast("double")
        number = F.expr(sql_search(f"cast({quote(f)} AS double)", cuts, [f"{k + 1}D" for k in range(len(cuts) + 1)]))
        placed[f] = F.when(x.isNull() | F.isnan(x), missing).otherwise(number)
    return df.withColumns(placed)


def fit_boosted(df: DataFrame, target: TargetSpec, features: Sequence[str], kind: str = "gradient_boosting", seed: int = 42, celled_rows: int = CELLED_ROWS, **params):
    """Boosted trees and the thresholds of their bins, or None where they are fitted on the rows themselves.

    A tree tells rows apart by their bins only, so rows of equal bins and class have the same residual in every round and
    are one weighted row: beyond ``celled_rows`` rows the rounds read those cells, whose number is bounded
    by the product of the bins however many rows there are.  Score such a model on :func:`in_bins`.
    """
    features = list(features)
    data = assembled(df, features, target)
    if data.count() <= celled_rows:
        return fit_tree(df, target, features, kind, seed, **params), None
    points = split_points(data, len(features), seed)
    known = df.filter(target.is_known).withColumn("label", F.when(target.is_bad, 1.0).otherwise(0.0))
    counts = in_bins(known, features, points).groupBy(*[col(f) for f in features], "label").agg(F.count(F.lit(1)).cast("double").alias(CLASS_WEIGHT))
    cells = stage(counts.repartition(df.sparkSession.sparkContext.defaultParallelism))
    # Room for every bin number among the estimator's own candidates, and a sample in which each occurs.
    estimator = tree_estimator(kind, seed, maxBins=256, **params).setWeightCol(CLASS_WEIGHT)
    return estimator.fit(assembled(cells, features, keep=["label", CLASS_WEIGHT])), points


def tree_facts(df: DataFrame, model) -> DataFrame:
    """One row: depth, leaves and a warning when the tree used all the depth it was allowed."""
    leaves = (model.numNodes + 1) // 2
    warning = "FULL_DEPTH_TREE" if model.depth >= model.getMaxDepth() else None
    return constants(df, [(model.depth, leaves, warning)], "depth int, leaves int, warning string")


def apply_tree(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the bad-class probability; a missing feature is an error."""
    if isinstance(model, DecisionTreeClassificationModel):
        values = [col(f).cast("double") for f in features]
        unplaced = reduce(or_, (v.isNull() | F.isnan(v) for v in values))
        missing = F.raise_error(F.lit("a feature is missing")).cast("double")
        p = F.expr(probability_sql(df.sparkSession, model, features))
        return df.select(*[col(c) for c in df.columns], F.when(unplaced, missing).otherwise(p).alias(PROBABILITY))
    vector = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    ready = vector.transform(df.withColumns({f: col(f).cast("double") for f in features}))
    scored = model.copy({model.featuresCol: "_features"}).transform(ready)
    return scored.select(*[col(c) for c in df.columns], vector_to_array("probability")[1].alias(PROBABILITY))


def importances(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    values = model.featureImportances.toArray()
    return constants(df, [(f, round(float(v), 6)) for f, v in zip(features, values)], "feature string, importance double")


def tree_rules(df: DataFrame, model, target: TargetSpec, features: Sequence[str]) -> DataFrame:
    """One row per leaf: its conditions, rows, bads and bad probability."""
    placed = model.transform(assembled(df, features, target))
    counts = placed.groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(F.col("label").cast("long")).alias("bad_count")
    )
    rules = constants(df, leaf_rules(df.sparkSession, model, features), "leaf int, rule string")
    return rules.join(counts, "leaf").select(
        (F.col("leaf") + 1).alias("rule_id"),
        "rule",
        F.when(F.col("bad_count") * 2 > F.col("sample_count"), 1).otherwise(0).alias("prediction"),
        F.round(ratio(F.col("bad_count"), F.col("sample_count")), 6).alias("probability"),
        "sample_count",
        "bad_count",
    )


# --- cross-validation ----------------------------------------------------------------


def with_folds(
    df: DataFrame, keys: Sequence[str], folds: int, seed: int = 42, by: Column | None = None, index: Callable[..., DataFrame] = dense_index
) -> DataFrame:
    """Add ``fold``: a hash of the row key, so folds do not depend on partitioning.

    With ``by`` folds are stratified: a row's place in the hash order of its class
    decides, so the folds of a class differ by one row at most.  ``index`` finds the place; both
    kinds give the same folds, and ``dense_index`` also the order of rows that tree fits draw from.
    """
    if by is not None:
        hashed = df.withColumns({"_h": hash_order(keys, seed), "_class": by})
        return index(hashed, ["_class"]).withColumn("fold", F.pmod("_index", F.lit(folds)).cast("int")).drop("_index", "_h", "_class")
    bucket = F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(bucket, F.lit(folds)).cast("int"))


def fold_metrics(scored: DataFrame) -> DataFrame:
    """AUC and macro F1 of ``(role, label, probability)`` rows, per role."""
    counts = stage(
        scored.groupBy("role", F.col(PROBABILITY).alias("value")).agg(
            F.sum(F.col("label").cast("long")).alias("bad"),
            F.sum((1 - F.col("label")).cast("long")).alias("good"),
        )
    )
    auc = auc_gini(running_totals(counts, "value", ["good", "bad"], ["role"])).select("role", "auc")
    high = lambda c, over: F.sum(F.when((F.col("value") >= 0.5) == F.lit(over), F.col(c)).otherwise(0))
    confusion = counts.groupBy("role").agg(
        high("bad", True).alias("tp"), high("good", True).alias("fp"), high("bad", False).alias("fn"), high("good", False).alias("tn")
    )
    f1 = lambda t: ratio(F.col(t) * 2, F.col(t) * 2 + F.col("fp") + F.col("fn"))
    return auc.join(confusion.select("role", F.round((f1("tp") + f1("tn")) / 2, 6).alias("f1_macro")), "role")


def cross_validate(
    df: DataFrame, target: TargetSpec, features: Sequence[str], keys: Sequence[str], kind: str, folds: int = 5, seed: int = 42, **params
) -> DataFrame:
    """``(fold, role, auc, f1_macro, overfit)``; overfit when mean test AUC trails train by 0.1.

    ``kind`` is a tree or "logistic", whose parameters are those of :class:`LogisticParams` and whose folds are fitted in shared passes.
    """
    if kind == "logistic":
        return _folds_table(df, _logistic_folds(df, target, features, keys, folds, seed, LogisticParams(**params)), folds)
    data = assembled(with_folds(df, keys, folds, seed, target.is_bad), features, target, keep=["fold"]).persist()
    try:
        parts = []
        for k in range(folds):
            model = tree_estimator(kind, seed, **dict(params)).fit(data.filter(F.col("fold") != k))
            scored = model.transform(data).select(
                F.when(F.col("fold") == k, F.lit("test")).otherwise(F.lit("train")).alias("role"),
                "label",
                vector_to_array("probability")[1].alias(PROBABILITY),
            )
            parts += [(k, r.role, r.auc, r.f1_macro) for r in fold_metrics(scored).collect()]
    finally:
        data.unpersist()
    return _folds_table(df, parts, folds)


def _logistic_folds(df, target, features, keys, folds, seed, params: LogisticParams) -> list[tuple]:
    """Figures of every fold from counts of its probabilities."""
    data = stage(model_rows(with_folds(df, keys, folds, seed, target.is_bad), target, features, F.col("fold")))
    fits = [params.fit(k) for k in range(folds)]
    betas, converged = fit_many(data, fits, params.max_iter)
    if not all(converged) and params.fail_on_no_convergence:
        raise ValueError(f"logistic regression did not converge in {params.max_iter} iterations")
    slices = slices_for(df, data.count() * len(fits))
    counts = stage(scored_counts(data, fits, betas, slices=slices).select(F.concat_ws("/", "fit", "role").alias("role"), "value", "good", "bad"))
    areas = {r.role: r.auc for r in auc_gini(running_totals(counts, "value", ["good", "bad"], ["role"], slices)).collect()}
    high = lambda c, over: F.sum(F.when((F.col("value") >= 0.5) == F.lit(over), F.col(c)).otherwise(0))
    sums = counts.groupBy("role").agg(high("bad", True).alias("tp"), high("good", True).alias("fp"), high("bad", False).alias("fn"), high("good", False).alias("tn"))
    f1 = lambda hit, r: 2 * hit / (2 * hit + r.fp + r.fn) if 2 * hit + r.fp + r.fn else 0.0
    return [(int(r.role.split("/")[0]), r.role.split("/")[1], areas[r.role], round((f1(r.tp, r) + f1(r.tn, r)) / 2, 6)) for r in sums.collect()]  # two rows per fold


def _folds_table(df: DataFrame, parts: list[tuple], folds: int) -> DataFrame:
    means = {role: sum(p[2] for p in parts if p[1] == role) / folds for role in ("train", "test")}
    overfit = means["test"] < means["train"] - 0.1
    return constants(df, [(*p, overfit) for p in parts], "fold int, role string, auc double, f1_macro double, overfit boolean")


_GRID_NAMES = {
    "max_depth": "maxDepth", "n_trees": "numTrees", "min_samples_leaf": "minInstancesPerNode",
    "learning_rate": "stepSize",
}


def tune(
    df: DataFrame,
    target: TargetSpec,
    features: Sequence[str],
    keys: Sequence[str],
    kind: str,
    grid: Mapping[str, Sequence],
    folds: int = 5,
    seed: int = 42,
    random_trials: int | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """``(params, mean_auc, std_auc, rank)`` of a grid or random search."""
    return tune_best(df, target, features, keys, kind, grid, folds, seed, random_trials, parallelism)[0]


def tune_best(
    df: DataFrame,
    target: TargetSpec,
    features: Sequence[str],
    keys: Sequence[str],
    kind: str,
    grid: Mapping[str, Sequence],
    folds: int = 5,
    seed: int = 42,
    random_trials: int | None = None,
    parallelism: int = 2,
    scoring: str = "areaUnderROC",
):
    """The search table and the best model, fitted again on all rows.

    ``scoring`` is areaUnderROC or areaUnderPR; the table's columns keep their names.  A
    logistic search, over ``c`` by the area under ROC, fits all folds and penalties in shared passes and gives a coefficient table.
    """
    import random

    if kind == "logistic":
        if set(grid) != {"c"} or scoring != "areaUnderROC":
            raise ValueError("a logistic search is over c, by areaUnderROC")
        return _tune_logistic(df, target, features, keys, list(grid["c"]), folds, seed, random_trials)
    data = assembled(with_folds(df, keys, folds, seed, target.is_bad), features, target, keep=["fold"]).persist()
    estimator = tree_estimator(kind, seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        spark_name = "maxIter" if name == "n_trees" and isinstance(estimator, GBTClassifier) else _GRID_NAMES[name]
        builder = builder.addGrid(getattr(estimator, spark_name), list(values))
    maps = builder.build()
    if random_trials is not None and random_trials < len(maps):
        maps = random.Random(seed).sample(maps, random_trials)
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="probability", metricName=scoring, numBins=0
    )
    try:
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="fold",
            parallelism=parallelism, seed=seed,
        ).fit(data)
    finally:
        data.unpersist()
    rows = []
    for params, mean, std in zip(maps, search.avgMetrics, search.stdMetrics):
        text = ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda e: e[0].name))
        rows.append((text, round(float(mean), 6), round(float(std), 6)))
    return _search_table(df, rows), search.bestModel


def _search_table(df: DataFrame, rows: list[tuple[str, float, float]]) -> DataFrame:
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    return constants(df, [(*r, i + 1) for i, r in enumerate(rows)], "params string, mean_auc double, std_auc double, rank int")


def _tune_logistic(df, target, features, keys, values, folds, seed, random_trials) -> tuple[DataFrame, DataFrame]:
    """All folds and penalties together; the chosen penalty once more on all rows."""
    import random

    if random_trials is not None and random_trials < len(values):
        values = random.Random(seed).sample(values, random_trials)
    data = stage(model_rows(with_folds(df, keys, folds, seed, target.is_bad, lean_index), target, features, F.col("fold")))
    fits = [LogisticParams(c=c).fit(k) for c in values for k in range(folds)]
    betas, converged = fit_many(data, fits)
    if not all(converged):
        raise ValueError("a logistic fit of the search did not converge")
    slices = slices_for(df, data.count() * len(values))  # every row is tested once a penalty
    won = slices_won(scored_counts(data, fits, betas, ["test"], slices))
    # One row per fit: a bad row that wins all the pairs that are won.
    ranking = constants(df, [(k, 1, 0, w / 2, bad, good) for (k, _), (w, good, bad) in won.items()], "role int, bad long, good long, before_good double, total_bad long, total_good long")
    areas = {r.role: r.auc for r in auc_gini(ranking).collect()}
    rows = []
    for i, c in enumerate(values):
        own = np.array([areas[i * folds + k] for k in range(folds)])
        rows.append((f"c={c}", round(float(own.mean()), 6), round(float(own.std()), 6)))
    best = max(zip(rows, values), key=lambda e: (e[0][1], [-ord(x) for x in e[0][0]]))[1]
    (beta,), _ = fit_many(data, [LogisticParams(c=best).fit()])
    return _search_table(df, rows), _coefficients(df, features, beta)
