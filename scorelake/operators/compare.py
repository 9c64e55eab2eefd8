"""Challenger against baseline, table by table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col


def side_by_side(
    baseline: DataFrame, challenger: DataFrame, keys: Sequence[str], values: Sequence[str], deltas: Sequence[str] = ()
) -> DataFrame:
    """Full outer join on the keys: both sides' values, presence flags and differences."""
    b = baseline.select(*keys, *[col(v).alias(f"baseline_{v}") for v in values], F.lit(True).alias("in_baseline"))
    c = challenger.select(*keys, *[col(v).alias(f"challenger_{v}") for v in values], F.lit(True).alias("in_challenger"))
    joined = b.join(c, list(keys), "full_outer")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return joined.select(
        *keys,
        F.coalesce("in_baseline", F.lit(False)).alias("in_baseline"),
        F.coalesce("in_challenger", F.lit(False)).alias("in_challenger"),
        *[F.col(f"{side}_{v}") for v in values for side in ("baseline", "challenger")],
        *[
            F.round(zero(f"challenger_{v}") - zero(f"baseline_{v}"), 6).alias(f"{v}_delta")
            for v in deltas
        ],
    )


def compare_iv(baseline: DataFrame, challenger: DataFrame) -> DataFrame:
    return side_by_side(baseline, challenger, ["variable"], ["iv", "bin_count"], ["iv", "bin_count"])


def compare_coefficients(baseline: DataFrame, challenger: DataFrame) -> DataFrame:
    return side_by_side(baseline, challenger, ["feature"], ["coefficient"], ["coefficient"])


def compare_validation(baseline: DataFrame, challenger: DataFrame) -> DataFrame:
    return side_by_side(baseline, challenger, ["role"], ["auc", "gini", "ks"], ["auc", "gini", "ks"])


def compare_cutoffs(baseline: DataFrame, challenger: DataFrame) -> DataFrame:
    """Bands with the same upper bound side by side, all cut-offs of every role."""
    values = ["approval_rate", "bad_rate", "capture_rate", "count"]
    named = [d.filter("upper IS NOT NULL").withColumnRenamed("upper", "cutoff") for d in (baseline, challenger)]
    return side_by_side(*named, ["role", "cutoff"], values)
