"""Platt and isotonic calibration and the calibration report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import constants, null_safe_join
from scorelake.functions.ordered import exact_quantiles
from scorelake.functions.placing import place
from scorelake.functions.state import stage
from scorelake.functions.target import TargetSpec
from scorelake.operators.isotonic import isotonic_blocks
from scorelake.operators.metrics import PROBABILITY
from scorelake.operators.model import with_folds
from scorelake.operators.newton import Fit, fit_many
from scorelake.operators.scaling import INTERCEPT

MIN_ROWS = 30
EPSILON = 1e-6


def safe_logit(p: Column, eps: float = EPSILON) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))
    return F.log(clipped / (F.lit(1.0) - clipped))


def _value_weights(df: DataFrame, target: TargetSpec, *by: str) -> DataFrame:
    """Distinct probabilities with their row and bad counts: all a calibrator needs."""
    return (
        df.filter(target.is_known)
        .groupBy(F.col(PROBABILITY).alias("p"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(target.is_bad, 1)).alias("bad"))
    )


@dataclass(frozen=True)
class Platt:
    """Averaged sigmoids of the log-odds; several when cross-validated."""

    parts: tuple[tuple[float, float], ...]  # (slope, intercept)
    status: str = "fitted"  # or "too_few_rows", which leaves probabilities as they are

    def transform(self, df: DataFrame, output: str = PROBABILITY) -> DataFrame:
        if not self.parts:
            return df.withColumn(output, F.col(PROBABILITY))
        z = safe_logit(F.col(PROBABILITY))
        total = F.lit(0.0)
        for slope, shift in self.parts:
            total = total + F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * z + F.lit(shift))))
        return df.withColumn(output, total / F.lit(float(len(self.parts))))

    def fold_into(self, coefficients: DataFrame) -> DataFrame:
        """Scale a linear model so it gives calibrated log-odds itself."""
        if len(self.parts) != 1:
            raise ValueError("only a single calibrator folds into coefficients")
        slope, shift = self.parts[0]
        scaled = F.col("coefficient") * F.lit(slope)
        return coefficients.select(
            "feature",
            F.round(F.when(F.col("feature") == INTERCEPT, scaled + F.lit(shift)).otherwise(scaled), 6).alias("coefficient"),
        )


def _fit_sigmoids(counts: DataFrame, fits: Sequence[Fit]) -> tuple[tuple[float, float], ...]:
    """``(slope, intercept)`` of every fit over ``counts (p, fold, n, bad)``, in shared passes."""
    sides = F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("bad").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("bad")).cast("double").alias("weight")),
    )
    rows = counts.select(F.array(safe_logit(F.col("p"))).alias("x"), "fold", F.inline(sides)).filter("weight > 0")
    betas, converged = fit_many(stage(rows), fits)
    if not all(converged):
        raise ValueError("a calibration fit did not converge")
    if any(beta[1] <= 0 for beta in betas):
        raise ValueError("calibration slope is not positive; the score order would invert")
    return tuple((float(beta[1]), float(beta[0])) for beta in betas)


def _enough(df: DataFrame, target: TargetSpec, min_rows: int) -> bool:
    return df.filter(target.is_known).limit(min_rows).count() >= min_rows


def fit_platt(
    df: DataFrame, target: TargetSpec, folds: int = 0, keys: Sequence[str] = (), seed: int = 42, min_rows: int = MIN_ROWS
) -> Platt:
    """Fewer than ``min_rows`` rows give the identity and say so; ``folds`` > 1 averages one sigmoid per training fold."""
    if not _enough(df, target, min_rows):
        return Platt((), "too_few_rows")
    if folds <= 1:
        return Platt(_fit_sigmoids(_value_weights(df, target).withColumn("fold", F.lit(-1)), [Fit(l2=1.0)]))
    counts = _value_weights(with_folds(df, keys, folds, seed), target, "fold")
    return Platt(_fit_sigmoids(counts, [Fit(l2=1.0, without=k) for k in range(folds)]))


@dataclass(frozen=True)
class Isotonic:
    """Averaged step functions; predictions outside the fitted range are clipped."""

    models: tuple
    status: str = "fitted"  # or "too_few_rows", which leaves probabilities as they are

    def transform(self, df: DataFrame, output: str = PROBABILITY) -> DataFrame:
        if not self.models:
            return df.withColumn(output, F.col(PROBABILITY))
        raw = "_raw_probability"
        current = df.withColumn(raw, F.col(PROBABILITY))
        for i, m in enumerate(self.models):
            current = m.copy({m.featuresCol: raw, m.predictionCol: f"_iso_{i}"}).transform(current)
        names = [f"_iso_{i}" for i in range(len(self.models))]
        total = sum((F.col(n) for n in names), F.lit(0.0)) / F.lit(float(len(names)))
        return current.withColumn(output, total).drop(*names, raw)


def fold_weights(df: DataFrame, target: TargetSpec, keys: Sequence[str], folds: int, seed: int) -> DataFrame:
    """Weights of every training part at once: ``part`` k has all rows but those of fold k."""
    folded = with_folds(df, keys, folds, seed).filter(target.is_known)
    bad = F.when(target.is_bad, 1).otherwise(0)
    held = lambda k, v: F.sum(F.when(F.col("fold") != k, v).otherwise(0))
    sums = [F.struct(F.lit(k).alias("part"), F.col(f"n{k}").alias("n"), F.col(f"b{k}").alias("bad")) for k in range(folds)]
    counted = folded.groupBy(F.col(PROBABILITY).alias("p")).agg(
        *[held(k, F.lit(1)).alias(f"n{k}") for k in range(folds)], *[held(k, bad).alias(f"b{k}") for k in range(folds)]
    )
    return counted.select("p", F.inline(F.array(*sums)))


def _fit_steps(weights: DataFrame, parts: int) -> tuple:
    """One model per part. Spark's regression only stores the pooled steps: their ends are in order already."""
    blocks = stage(isotonic_blocks(weights.filter("p IS NOT NULL")))
    mean = (F.col("bad") / F.col("n")).alias("label")
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("features")
    points = blocks.select("part", mean, ends, F.lit(1.0).alias("weight"))
    return tuple(IsotonicRegression(weightCol="weight").fit(points.filter(F.col("part") == k)) for k in range(parts))


def fit_isotonic(
    df: DataFrame, target: TargetSpec, folds: int = 0, keys: Sequence[str] = (), seed: int = 42, min_rows: int = MIN_ROWS
) -> Isotonic:
    """Fitted on distinct probabilities weighted by their rows, so ties are one point; ``min_rows`` as for Platt.

    All training folds are counted in one pass and pooled together.
    """
    if not _enough(df, target, min_rows):
        return Isotonic((), "too_few_rows")
    if folds <= 1:
        return Isotonic(_fit_steps(_value_weights(df, target).withColumn("part", F.lit(0)), 1))
    return Isotonic(_fit_steps(fold_weights(df, target, keys, folds, seed), folds))


def calibration_report(df: DataFrame, target: TargetSpec, raw: str, calibrated: str, bins: int = 10) -> DataFrame:
    """Per percentile bin of the calibrated probability: raw, calibrated and actual rates.

    Bins are ``[lo, hi)``, the last one closed.  ``mean_deviation`` and
    ``max_deviation`` repeat the whole report's figures.
    """
    known = df.filter(target.is_known).select(
        F.col(raw).alias("raw"), F.col(calibrated).alias("cal"), F.when(target.is_bad, 1.0).otherwise(0.0).alias("y")
    )
    probs = [k / bins for k in range(1, bins)]
    edges = [r.q for r in sorted(exact_quantiles(known, ["cal"], probs).collect(), key=lambda r: r.p)]
    breaks = constants(df, [(edges,)], "breaks array<double>")
    deviation = F.abs(F.col("c") - F.col("a"))
    rows = (
        place(known, "cal", breaks, left_closed=True)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("cal").alias("c"), F.avg("raw").alias("r"), F.avg("y").alias("a"))
        .select(
            "bin", "count", F.round("c", 6).alias("avg_predicted"), F.round("r", 6).alias("avg_predicted_raw"),
            F.round("a", 6).alias("actual_bad_rate"), F.round(deviation, 6).alias("abs_deviation"),
        )
    )
    whole = rows.agg(
        F.round(F.avg("abs_deviation"), 6).alias("mean_deviation"), F.max("abs_deviation").alias("max_deviation")
    ).withColumn("_all", F.lit(1))
    return null_safe_join(rows.withColumn("_all", F.lit(1)), whole, ["_all"]).drop("_all")
