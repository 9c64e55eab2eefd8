"""Outcomes by sensitive group and proxies of sensitive columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorelake.functions.columns import col, constants, count_if, null_safe_join, ratio, safe_corr
from scorelake.functions.ordered import exact_quantiles
from scorelake.functions.target import TargetSpec
from scorelake.operators.metrics import PROBABILITY, SCORE


def fairness_groups(
    df: DataFrame, target: TargetSpec, sensitive: str, cutoff: float = 0.5, min_group: int = 30
) -> DataFrame:
    """Rates and score statistics per role and group; small groups show their size only."""
    base = df.select(
        "role",
        col(sensitive).cast("string").alias("group"),
        SCORE,
        (F.col(PROBABILITY) >= F.lit(float(cutoff))).alias("declined"),
        target.is_bad.alias("bad"),
    )
    declined, bad = F.col("declined"), F.col("bad")
    counts = base.groupBy("role", "group").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(declined).alias("rejected"),
        count_if(bad).alias("n_bad"),
        count_if(bad & declined).alias("tp"),
        count_if(~bad & declined).alias("fp"),
        count_if(bad & ~declined).alias("fn"),
        count_if(~bad & ~declined).alias("tn"),
        F.avg(SCORE).alias("mean"),
    )
    points = exact_quantiles(base, [SCORE], [0.25, 0.5, 0.75], ["role", "group"])
    wide = points.groupBy("role", "group").agg(
        *[
            F.max(F.when(F.col("p") == F.lit(p), F.col("q"))).alias(name)
            for p, name in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))
        ]
    )
    enough = F.col("n") >= F.lit(min_group)
    shown = {
        "approval_rate": F.round(F.lit(1.0) - F.col("rejected") / F.col("n"), 4),
        "n_bad": F.col("n_bad"),
        "bad_rate": F.round(F.col("n_bad") / F.col("n"), 4),
        "precision": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4),
        "recall": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4),
        "specificity": F.round(ratio(F.col("tn"), F.col("tn") + F.col("fp")), 4),
        "false_positive_rate": F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), 4),
        "score_mean": F.round("mean", 2),
        "score_median": F.round("median", 2),
        "score_p25": F.round("p25", 2),
        "score_p75": F.round("p75", 2),
    }
    return null_safe_join(counts, wide, ["role", "group"], "left").select(
        "role",
        "group",
        "n",
        F.when(enough, F.lit("ok")).otherwise(F.lit("insufficient_evidence")).alias("status"),
        *[F.when(enough, e).alias(name) for name, e in shown.items()],
    )


def fairness_parity(groups: DataFrame) -> DataFrame:
    """Largest differences between valid groups, per role with at least two."""
    spread = lambda c: F.round(F.max(c) - F.min(c), 4)
    return (
        groups.filter("status = 'ok'")
        .groupBy("role")
        .agg(
            F.count(F.lit(1)).alias("group_count"),
            spread("approval_rate").alias("max_approval_rate_difference"),
            spread("bad_rate").alias("max_bad_rate_difference"),
            spread("false_positive_rate").alias("max_false_positive_rate_difference"),
        )
        .filter("group_count >= 2")
    )


_PROXY_ROWS = "array<struct<sensitive_column:string,feature:string,correlation:double,same_column:boolean,importance:double>>"


def proxy_risk(
    df: DataFrame,
    sensitive: Sequence[str],
    features: Sequence[str],
    importance: Mapping[str, float] | None = None,
    correlation_threshold: float = 0.3,
    importance_threshold: float = 0.05,
) -> DataFrame:
    """Per sensitive column and feature: absolute correlation and the column's risk level.

    High when a feature is the column itself or correlates above the threshold;
    otherwise medium when the column's own importance is above its threshold.  A
    sensitive column that is absent has one row without a feature and risk "unknown".
    """
    importance = dict(importance or {})
    is_number = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    pairs = [(s, f) for s in sensitive for f in features if s in is_number and f in is_number]
    measured = [(s, f) for s, f in pairs if s != f and is_number[s] and is_number[f]]
    numbers = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[safe_corr(col(s).cast("double"), col(f).cast("double")).alias(f"c_{i}") for i, (s, f) in enumerate(measured)],
    )
    rows = []
    for s, f in pairs:
        value = F.lit(None).cast("double")
        if (s, f) in measured:
            raw = F.abs(F.col(f"c_{measured.index((s, f))}"))
            value = F.when(~F.isnan(raw), F.round(raw, 4))
        rows.append(
            F.struct(
                F.lit(s).alias("sensitive_column"),
                F.lit(f).alias("feature"),
                value.alias("correlation"),
                F.lit(s == f).alias("same_column"),
                F.lit(float(importance.get(s, 0.0))).alias("importance"),
            )
        )
    table = numbers.select(F.inline(F.array(*rows).cast(_PROXY_ROWS)))
    is_proxy = F.col("same_column") | F.coalesce(F.col("correlation") > F.lit(correlation_threshold), F.lit(False))
    column = Window.partitionBy("sensitive_column")
    absent = constants(df, [(s,) for s in sensitive if s not in is_number], "sensitive_column string").select(
        "sensitive_column", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("correlation"),
        F.lit(False).alias("is_proxy"), F.lit("unknown").alias("risk_level"),
    )
    rated = table.select(
        "sensitive_column",
        "feature",
        "correlation",
        is_proxy.alias("is_proxy"),
        F.when(F.max(is_proxy).over(column), F.lit("high"))
        .when(F.col("importance") > F.lit(importance_threshold), F.lit("medium"))
        .otherwise(F.lit("low"))
        .alias("risk_level"),
    )
    return rated.unionByName(absent)
