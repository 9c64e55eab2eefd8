"""Checks of a fitted logistic model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col
from scorelake.functions.state import stage
from scorelake.operators.corr import correlation_matrix
from scorelake.operators.scaling import INTERCEPT

# Coefficient size that suggests separation, VIF that warns.
SEPARATION_LIMIT = 10.0
VIF_LIMIT = 10.0


def coefficient_signs(coefficients: DataFrame) -> DataFrame:
    """A WOE coefficient should be negative: more WOE, fewer bads."""
    c = F.col("coefficient")
    return coefficients.filter(F.col("feature").endswith("_woe")).select(
        "feature",
        "coefficient",
        F.when(c > 0, F.lit("positive")).when(c < 0, F.lit("negative")).otherwise(F.lit("zero")).alias("sign"),
        F.when(c > 0, F.lit("warning")).when(c == 0, F.lit("neutral")).otherwise(F.lit("pass")).alias("status"),
    )


def separation(coefficients: DataFrame, limit: float = SEPARATION_LIMIT) -> DataFrame:
    size = F.abs("coefficient")
    infinite = size == F.lit(float("inf"))
    return coefficients.filter(F.col("feature") != INTERCEPT).select(
        "feature",
        size.alias("abs_coefficient"),
        F.when(infinite, F.lit("fail")).when(size > F.lit(limit), F.lit("warning")).otherwise(F.lit("pass")).alias("status"),
    )


def vif(df: DataFrame, features: Sequence[str], limit: float = VIF_LIMIT) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix.

    Correlations come from one pass over the rows; only the k by k matrix is
    inverted, inside one small grouped task.
    """
    names = list(features)
    df = stage(df.select(*[col(c) for c in names]))  # read three times, and its columns may be costly expressions
    corr = correlation_matrix(df, names, missing="complete_case")
    spreads = df.dropna(subset=names).agg(*[F.stddev_pop(col(c)).alias(c) for c in names]).first()
    flat = {c for c in names if not spreads[c]}

    def invert(table: pd.DataFrame) -> pd.DataFrame:
        position = {c: i for i, c in enumerate(names)}
        matrix = np.eye(len(names))
        a, b = table["variable_a"].map(position), table["variable_b"].map(position)
        matrix[a, b] = matrix[b, a] = table["corr"]
        try:
            values = [None] * len(names) if flat else list(np.diag(np.linalg.inv(matrix)))
        except np.linalg.LinAlgError:
            values = [None] * len(names)
        return pd.DataFrame({"feature": names, "vif": pd.Series(values, dtype="float64")})

    inverted = corr.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(invert, "feature string, vif double")
    known = F.col("vif").isNotNull() & ~F.isnan("vif")
    return inverted.select(
        "feature",
        F.when(known, F.round("vif", 6)).alias("vif"),
        F.when(known, F.round(F.lit(1.0) - F.lit(1.0) / F.col("vif"), 6)).alias("r_squared"),
        F.when(known & (F.col("vif") < F.lit(limit)), F.lit("pass")).otherwise(F.lit("warning")).alias("status"),
    )
