"""Permutation importance, its stability, and partial dependence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import constants, safe_corr
from scorelake.functions.hashing import dense_index, hash_order
from scorelake.functions.ordered import exact_quantiles
from scorelake.functions.state import stage
from scorelake.functions.target import TargetSpec
from scorelake.operators.model import assembled
from scorelake.operators.permuted import permuted_hits
from scorelake.operators.scaling import INTERCEPT
from scorelake.operators.trees import TREE_MODELS, dependence, forest_of


def coefficient_magnitude(coefficients: DataFrame) -> DataFrame:
    """Importance of a linear model's features."""
    return coefficients.filter(F.col("feature") != INTERCEPT).select(
        "feature", F.round(F.abs("coefficient"), 6).alias("importance")
    )


def permutation_importance(
    df: DataFrame, model, target: TargetSpec, features: Sequence[str], keys: Sequence[str], repeats: int = 5, seed: int = 42
) -> DataFrame:
    """``(feature, importance_mean, importance_std)``: accuracy lost when a feature is shuffled.

    A shuffle meets the rows of one hash order with the values of another at the same ranks.  One permutation serves all
    features of a repeat.  For a tree model rows are lined up in packed slices (see :func:`~scorelake.operators.permuted.permuted_hits`); for
    any other a shuffle is one join, and the variants of a row are scored together.
    """
    accuracy = lambda: F.avg((F.col("prediction") == F.col("label")).cast("double"))
    if isinstance(model, TREE_MODELS):
        rows = assembled(df, features, target, keep=list(keys))
        baseline = model.transform(rows.select("label", "features")).agg(accuracy().alias("a")).first().a
        packed = rows.select(*keys, "label", vector_to_array("features").alias("x"))
        hits = permuted_hits(packed, forest_of(df.sparkSession, model), len(features), keys, seed, [seed + 1 + r for r in range(repeats)])
        told = [(f, baseline - met / n) for repeat in hits for f, (n, met) in zip(features, repeat)]
        return _loss_table(constants(df, told, "feature string, loss double"))
    base = stage(
        assembled(df, features, target, keep=list(keys)).select(
            *keys, "label", vector_to_array("features").alias("x")
        )
    )
    fixed = stage(dense_index(base.withColumn("_h", hash_order(keys, seed))).select("_index", "label", "x"))
    baseline = (
        model.transform(base.select("label", array_to_vector("x").alias("features"))).agg(accuracy().alias("a")).first().a
    )
    losses = []
    for r in range(repeats):
        shuffled = dense_index(base.withColumn("_h", hash_order(keys, seed + 1 + r))).select(
            "_index", F.col("x").alias("other")
        )
        variants = F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.concat(F.slice("x", 1, i), F.array(F.col("other")[i]), F.slice("x", i + 2, len(features))).alias("v"),
                )
                for i, f in enumerate(features)
            ]
        )
        rows = fixed.join(shuffled, "_index").select("label", F.inline(variants))
        scored = model.transform(rows.select("feature", "label", array_to_vector("v").alias("features")))
        losses.append(
            scored.groupBy("feature").agg((F.lit(baseline) - accuracy()).alias("loss")).withColumn("repeat", F.lit(r))
        )
    every = losses[0]
    for part in losses[1:]:
        every = every.unionByName(part)
    return _loss_table(every)


def _loss_table(losses: DataFrame) -> DataFrame:
    return losses.groupBy("feature").agg(
        F.round(F.avg("loss"), 6).alias("importance_mean"), F.round(F.stddev_pop("loss"), 6).alias("importance_std")
    )


def importance_stability(table: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Mean Spearman correlation of feature ranks between seeds: ``(seed, feature, importance)`` in, one row out."""
    ranked = table.withColumn(
        "rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("importance"), "feature"))
    )
    a = ranked.select(F.col("seed").alias("seed_a"), "feature", F.col("rank").alias("rank_a"))
    b = ranked.select(F.col("seed").alias("seed_b"), "feature", F.col("rank").alias("rank_b"))
    pairs = (
        a.join(b, "feature").filter("seed_a < seed_b").groupBy("seed_a", "seed_b")
        .agg(safe_corr(F.col("rank_a"), F.col("rank_b")).alias("rho"))
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("seed_pairs"), F.round(F.avg("rho"), 4).alias("mean_rank_correlation")
    ).withColumn("top_features_changed", F.col("mean_rank_correlation") < F.lit(threshold))


def partial_dependence(
    df: DataFrame, model, features: Sequence[str], importances: DataFrame, top: int = 3, grid_points: int = 100
) -> DataFrame:
    """``(feature, grid_value, average_prediction)`` for the most important features.

    The grid runs from the 5th to the 95th percentile, or over the values
    themselves when there are few.  ``model`` is a tree model or a coefficient table; rows are read once for all features and
    grid values (see :func:`~scorelake.operators.trees.dependence`).
    """
    chosen = [r.feature for r in importances.orderBy(F.desc("importance"), "feature").limit(top).collect()]
    ends = {(r.variable, r.p): r.q for r in exact_quantiles(df, chosen, [0.05, 0.95]).collect()}
    grids = {}
    for f in chosen:
        values = sorted(r[0] for r in df.select(F.col(f).cast("double")).distinct().limit(grid_points).collect())
        lo, hi = ends[(f, 0.05)], ends[(f, 0.95)]
        grids[f] = values if len(values) < grid_points else [lo + (hi - lo) * k / (grid_points - 1) for k in range(grid_points)]
    rows = assembled(df, features).select(vector_to_array("features").alias("x"))
    points = constants(df, [(f, k, float(g)) for f, grid in grids.items() for k, g in enumerate(grid)], "feature string, place int, grid_value double")
    return dependence(rows, model, features, grids).join(F.broadcast(points), ["feature", "place"]).select(
        "feature", F.round("grid_value", 6).alias("grid_value"), F.round("average", 6).alias("average_prediction")
    )
