"""Applying a scorecard: log-odds, probability, score and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col, sql_number
from scorelake.functions.state import collect_state
from scorelake.operators.binning import bins_by_variable, case_by_bin
from scorelake.operators.metrics import PROBABILITY, SCORE
from scorelake.operators.scaling import Scaling, model_of

RAW = "raw_model_output"


def log_odds(coefficients: DataFrame) -> Column:
    intercept, slopes = model_of(coefficients)
    total = F.lit(intercept)
    for feature, value in slopes.items():
        total = total + col(feature) * F.lit(value)
    return total


def apply_logistic(df: DataFrame, coefficients: DataFrame, scaling: Scaling | None = Scaling()) -> DataFrame:
    """Add raw output, bad probability and, with a scaling, the score."""
    _, slopes = model_of(coefficients)
    missing = [f for f in slopes if f not in df.columns]
    if missing:
        raise ValueError(f"model features are missing: {missing}")
    scored = df.withColumn(RAW, log_odds(coefficients)).withColumn(
        PROBABILITY, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(RAW)))
    )
    return scored if scaling is None else scored.withColumn(SCORE, score_of(F.col(RAW), scaling))


def score_of(raw: Column, scaling: Scaling) -> Column:
    return F.lit(scaling.offset) + F.lit(scaling.direction * scaling.factor) * raw


def score_probability(df: DataFrame, scaling: Scaling = Scaling(), eps: float = 1e-15) -> DataFrame:
    """Score a model that only gives a probability, through clipped log-odds."""
    p = F.greatest(F.least(F.col(PROBABILITY), F.lit(1.0 - eps)), F.lit(eps))
    raw = F.log(p / (F.lit(1.0) - p))
    return df.withColumn(RAW, raw).withColumn(SCORE, score_of(F.col(RAW), scaling))


def add_points(df: DataFrame, bins: DataFrame, card: DataFrame, base_points: float) -> DataFrame:
    """Add ``total_points``: base points plus the points of each variable's bin."""
    points = {(r.variable, r.bin_id): r.points for r in collect_state(card.select("variable", "bin_id", "points"))}
    used = {v for v, _ in points}
    total = F.lit(float(base_points))
    for variable, entries in bins_by_variable(bins).items():
        if variable in used:
            values = [sql_number(points[(variable, e.bin_id)]) for e in entries]
            total = total + F.expr(case_by_bin(entries, values))
    return df.withColumn("total_points", total)


def score_summary(df: DataFrame) -> DataFrame:
    """Smallest, largest and mean probability and score per role."""
    return df.groupBy("role").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.min(PROBABILITY), 6).alias("min_probability"),
        F.round(F.max(PROBABILITY), 6).alias("max_probability"),
        F.round(F.avg(PROBABILITY), 6).alias("mean_probability"),
        F.round(F.min(SCORE), 2).alias("min_score"),
        F.round(F.max(SCORE), 2).alias("max_score"),
        F.round(F.avg(SCORE), 2).alias("mean_score"),
    )
