"""Choosing variables by IV, cluster, filters and tree importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import col, constants, count_if, null_safe_join
from scorelake.functions.state import collect_state
from scorelake.operators.corr import correlation_matrix


@dataclass(frozen=True)
class SelectionParams:
    """``cluster_rule``: none, highest_iv, lowest_missing or manual_override.

    Manual includes and excludes map a variable to its reason; ``overrides``
    map a cluster id to (variable, reason).
    """

    min_iv: float = 0.02
    max_variables: int = 15
    includes: Mapping[str, str] = field(default_factory=dict)
    excludes: Mapping[str, str] = field(default_factory=dict)
    cluster_rule: str = "none"
    overrides: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, reason in {**self.includes, **self.excludes}.items():
            if not name or not reason:
                raise ValueError("manual includes and excludes need a variable and a reason")
        if self.cluster_rule not in ("none", "highest_iv", "lowest_missing", "manual_override"):
            raise ValueError(f"unknown cluster rule {self.cluster_rule!r}")


def _reasons(df: DataFrame, mapping: Mapping[str, str], name: str) -> DataFrame:
    return F.broadcast(constants(df, list(mapping.items()), f"variable string, {name} string"))


def select_variables(
    iv: DataFrame, params: SelectionParams = SelectionParams(), clusters: DataFrame | None = None
) -> DataFrame:
    """``(variable, iv, decision, reason)`` for every variable with an IV.

    With a cluster rule the representatives come first, in cluster order; other
    members of a decided cluster are rejected.  The rest follow by IV.
    """
    table = iv.select("variable", "iv")
    table = null_safe_join(table, _reasons(iv, params.includes, "include_reason"), ["variable"], "left")
    table = null_safe_join(table, _reasons(iv, params.excludes, "exclude_reason"), ["variable"], "left")
    use_clusters = params.cluster_rule != "none" and clusters is not None
    if use_clusters:
        members = clusters.filter("cluster_id IS NOT NULL").select("variable", "cluster_id", "missing_rate")
        table = null_safe_join(table, members, ["variable"], "left")
        picks = constants(
            iv, [(c, v, r) for c, (v, r) in params.overrides.items()],
            "cluster_id string, override string, override_reason string",
        )
        table = null_safe_join(table, F.broadcast(picks), ["cluster_id"], "left")
    else:
        nothing = F.lit(None).cast("string")
        table = table.withColumns(
            {"cluster_id": nothing, "missing_rate": F.lit(None).cast("double"), "override": nothing, "override_reason": nothing}
        )
    eligible = F.col("exclude_reason").isNull()
    passes = F.col("iv") >= F.lit(params.min_iv)
    cluster = Window.partitionBy("cluster_id")
    by_iv = [F.desc("iv"), F.asc("variable")]
    first_choice = {
        "highest_iv": by_iv,
        "lowest_missing": [F.asc(F.coalesce("missing_rate", F.lit(float("inf")))), *by_iv],
    }.get(params.cluster_rule)
    overridden = F.max(eligible & (F.col("variable") == F.col("override"))).over(cluster)
    order = cluster.orderBy(
        F.desc(F.coalesce(eligible & (F.col("variable") == F.col("override")), F.lit(False))),
        F.desc(eligible),
        *(first_choice or by_iv),
    )
    decided = F.coalesce(overridden, F.lit(False)) if first_choice is None else F.lit(True)
    in_cluster = F.col("cluster_id").isNotNull()
    table = table.withColumns({"place": F.row_number().over(order), "decided": in_cluster & decided})
    representative = F.col("decided") & (F.col("place") == 1) & eligible
    # Undecided clusters keep their first passing member by IV.
    passing_order = Window.partitionBy("cluster_id", passes & eligible & F.col("include_reason").isNull()).orderBy(*by_iv)
    table = table.withColumn("passing_place", F.row_number().over(passing_order))
    manual = eligible & F.col("include_reason").isNotNull() & ~representative
    skipped = in_cluster & ~representative & ~manual & (F.col("decided") | (passes & (F.col("passing_place") > 1)))
    accepted = representative | manual | (eligible & passes & ~skipped)
    flagged = table.withColumns({"representative": representative, "manual": manual, "skipped": skipped, "accepted": accepted})
    sequence = Window.partitionBy(F.lit(0)).orderBy(  # one row per variable
        F.desc("representative"), F.when(F.col("representative"), F.col("cluster_id")), *by_iv
    )
    counted = flagged.withColumn(
        "earlier",
        F.coalesce(
            F.sum(F.col("accepted").cast("int")).over(sequence.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    full = F.col("earlier") >= F.lit(params.max_variables)
    iv_text = F.format_string("%.4f", "iv")
    limit_text = F.lit(f"Reached max_variables limit ({params.max_variables})")
    low = F.concat(F.lit("IV "), iv_text, F.lit(f" below threshold {params.min_iv}"))
    high = F.concat(F.lit("IV "), iv_text, F.lit(f" above threshold {params.min_iv}"))
    why_representative = F.when(
        F.col("variable") == F.col("override"),
        F.concat(F.lit("Cluster representative override: "), F.col("override_reason")),
    )
    if params.cluster_rule == "lowest_missing":
        why_representative = F.coalesce(
            why_representative,
            F.concat(F.lit("lowest missing rate ("), F.format_string("%.4f", "missing_rate"), F.lit(") in cluster")),
            F.lit("lowest missing rate in cluster"),
        )
    else:
        why_representative = F.coalesce(why_representative, F.concat(F.lit("highest IV ("), iv_text, F.lit(") in cluster")))
    return counted.select(
        "variable",
        "iv",
        F.when(F.col("accepted") & ~full, F.lit("selected")).otherwise(F.lit("rejected")).alias("decision"),
        F.when(F.col("exclude_reason").isNotNull(), F.col("exclude_reason"))
        .when(F.col("skipped"), F.concat(F.lit("Not the representative of "), F.col("cluster_id")))
        .when(full & (F.lit(not use_clusters) | F.col("accepted")), limit_text)
        .when(F.col("representative"), why_representative)
        .when(F.col("manual"), F.col("include_reason"))
        .when(F.col("accepted"), high)
        .otherwise(low)
        .alias("reason"),
    )


@dataclass(frozen=True)
class FilterParams:
    min_iv: float = 0.02
    max_missingness: float = 0.5
    max_correlation: float = 0.85
    min_variance: float = 1e-6
    max_features: int | None = None


def select_by_filters(
    df: DataFrame, features: Sequence[str], iv: DataFrame | None = None, params: FilterParams = FilterParams()
) -> DataFrame:
    """``(variable, decision, method, score)`` after missingness, variance, IV, correlation, count.

    Of two features correlating above the limit the one with the lower IV goes;
    pairs are visited in feature order among those still present.
    """
    aggregates = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[count_if(col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(features)],
        *[F.var_samp(col(c).cast("double")).alias(f"v_{i}") for i, c in enumerate(features)],
    ).first()
    iv_of = {r.variable: r.iv for r in collect_state(iv.select("variable", "iv"))} if iv is not None else {}
    outcome: dict[str, tuple[str, str, float | None]] = {}
    for i, c in enumerate(features):
        missing = aggregates[f"m_{i}"] / aggregates.n if aggregates.n else 0.0
        variance = aggregates[f"v_{i}"]
        if missing > params.max_missingness:
            outcome[c] = ("rejected", "missingness", round(missing, 6))
        elif variance is not None and variance < params.min_variance:
            outcome[c] = ("rejected", "variance", round(variance, 6))
        elif iv_of and iv_of.get(c, 0.0) < params.min_iv:
            outcome[c] = ("rejected", "iv", round(iv_of.get(c, 0.0), 6))
    left = [c for c in features if c not in outcome]
    if params.max_correlation < 1.0 and len(left) > 1:
        close = {
            (r.variable_a, r.variable_b)
            for r in collect_state(
                correlation_matrix(df, left, absolute=True).filter(F.col("corr") > F.lit(params.max_correlation))
            )
        }
        for a, b in [(a, b) for i, a in enumerate(left) for b in left[i + 1 :]]:
            if (a, b) in close and a not in outcome and b not in outcome:
                loser = b if iv_of.get(a, 0.0) >= iv_of.get(b, 0.0) else a
                outcome[loser] = ("rejected", "correlation", 1.0)
    left = [c for c in left if c not in outcome]
    if params.max_features and len(left) > params.max_features:
        ordered = sorted(left, key=lambda c: -iv_of.get(c, 0.0))
        for c in ordered[params.max_features :]:
            outcome[c] = ("rejected", "max_features", iv_of.get(c, 0.0))
    rows = [(c, *outcome.get(c, ("selected", "filter", iv_of.get(c)))) for c in features]
    return constants(df, rows, "variable string, decision string, method string, score double")


def select_by_importance(importances: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Keep features whose tree importance reaches the threshold."""
    kept: Column = F.col("importance") >= F.lit(float(threshold))
    return importances.select(
        F.col("feature").alias("variable"),
        "importance",
        F.when(kept, F.lit("selected")).otherwise(F.lit("rejected")).alias("decision"),
    )
