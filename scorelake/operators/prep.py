"""Exclusions, segments, treatment and sample definitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.columns import col, constants, count_if
from scorelake.functions.target import TargetSpec

OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in", "not_in", "is_null", "is_not_null")


@dataclass(frozen=True)
class Rule:
    column: str
    operator: str
    value: Any = None
    reason: str = ""


def rule_mask(df: DataFrame, rule: Rule) -> Column:
    """The rule's condition; null where the value is null (except null tests)."""
    if not rule.reason.strip():
        raise ValueError(f"rule on {rule.column!r} needs a reason")
    if rule.column not in df.columns:
        raise ValueError(f"rule names unknown column {rule.column!r}")
    if rule.operator not in OPERATORS:
        raise ValueError(f"unsupported operator {rule.operator!r}")
    value = col(rule.column)
    is_number = isinstance(rule.value, (int, float)) and not isinstance(rule.value, bool)
    if is_number and isinstance(df.schema[rule.column].dataType, T.StringType):
        value = value.cast("double")
    if rule.operator in ("in", "not_in"):
        if not isinstance(rule.value, (list, tuple, set, frozenset)):
            raise ValueError(f"operator {rule.operator!r} on {rule.column!r} needs a list")
        inside = value.isin(*rule.value)
        return inside if rule.operator == "in" else ~inside
    if rule.operator == "is_null":
        return value.isNull()
    if rule.operator == "is_not_null":
        return value.isNotNull()
    literal = F.lit(rule.value)
    return {
        "==": lambda: value == literal,
        "!=": lambda: value != literal,
        "<": lambda: value < literal,
        "<=": lambda: value <= literal,
        ">": lambda: value > literal,
        ">=": lambda: value >= literal,
    }[rule.operator]()


def _first_rule(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """Number of the first rule that drops the row; null when none does.

    A null condition drops the row too, as a filter on the negation would.
    """
    chain: Column | None = None
    for i, rule in enumerate(rules):
        dropped = F.coalesce(rule_mask(df, rule), F.lit(True))
        chain = F.when(dropped, F.lit(i)) if chain is None else chain.when(dropped, F.lit(i))
    return chain if chain is not None else F.lit(None).cast("int")


def apply_exclusions(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows no exclusion rule drops, in one pass."""
    return df.filter(_first_rule(df, rules).isNull())


def exclusion_waterfall(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: rows it matched and rows it dropped, among those still present."""
    masks = [rule_mask(df, r) for r in rules]
    first = df.select(
        _first_rule(df, rules).alias("first"), *[m.alias(f"m_{i}") for i, m in enumerate(masks)]
    )
    counts = first.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            count_if((F.col("first") == i) & F.col(f"m_{i}")).alias(f"removed_{i}")
            for i in range(len(rules))
        ],
        *[count_if(F.col("first") == i).alias(f"dropped_{i}") for i in range(len(rules))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("rule"),
                F.lit(r.column).alias("column"),
                F.lit(r.operator).alias("operator"),
                F.lit(r.reason).alias("reason"),
                F.col(f"removed_{i}").alias("rows_removed"),
                F.col(f"dropped_{i}").alias("rows_dropped"),
                (
                    F.col("total") - reduce(lambda a, b: a + b, [F.col(f"dropped_{j}") for j in range(i + 1)])
                ).alias("rows_left"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counts.select(F.inline(rows))


def segment_filter(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that meet every rule of a segment."""
    for r in rules:
        if r.value is None and r.operator not in ("is_null", "is_not_null"):
            raise ValueError(f"segment rule on {r.column!r} needs a value")
    return df.filter(reduce(lambda a, b: a & b, [rule_mask(df, r) for r in rules]))


@dataclass(frozen=True)
class Treatment:
    """``kind``: impute, cap or floor, with the value and the reason for it."""

    column: str
    kind: str
    value: Any
    reason: str

    def __post_init__(self) -> None:
        if self.kind not in ("impute", "cap", "floor"):
            raise ValueError(f"unknown treatment {self.kind!r}")
        if not self.reason.strip():
            raise ValueError(f"treatment of {self.column!r} needs a reason")


_TREATMENT_ORDER = ("impute", "cap", "floor")


def treat(df: DataFrame, treatments: Sequence[Treatment]) -> DataFrame:
    """Impute, then cap, then floor; nulls that are not imputed stay null."""
    return df.withColumns(_treated_columns(df, treatments)[0])


def _treated_columns(df: DataFrame, treatments: Sequence[Treatment]) -> tuple[dict[str, Column], list[tuple[Treatment, Column]]]:
    current: dict[str, Column] = {}
    changes: list[tuple[Treatment, Column]] = []
    for kind in _TREATMENT_ORDER:
        for t in (t for t in treatments if t.kind == kind):
            if t.column not in df.columns:
                raise ValueError(f"treatment names unknown column {t.column!r}")
            before = current.get(t.column, col(t.column))
            kind_of = df.schema[t.column].dataType
            if kind != "impute" and not isinstance(kind_of, T.NumericType):
                raise ValueError(f"column {t.column!r} is not numeric")
            # A fractional limit widens a column of whole numbers instead of being cut to one.
            fractional = isinstance(kind_of, T.IntegralType) and isinstance(t.value, float) and not t.value.is_integer()
            value = F.lit(float(t.value)) if fractional else F.lit(t.value).cast(kind_of)
            before = before.cast("double") if fractional else before
            if kind == "impute":
                changed = before.isNull()
            else:
                changed = before > value if kind == "cap" else before < value
            changes.append((t, changed))
            current[t.column] = F.when(changed, value).otherwise(before)
    return current, changes


def treatment_summary(df: DataFrame, treatments: Sequence[Treatment]) -> DataFrame:
    """How many values each treatment changes."""
    _, changes = _treated_columns(df, treatments)
    counts = df.agg(*[count_if(c).alias(f"n_{i}") for i, (_, c) in enumerate(changes)])
    rows = F.array(
        *[
            F.struct(
                F.lit(t.column).alias("column"),
                F.lit(t.kind).alias("kind"),
                F.lit(t.reason).alias("reason"),
                F.col(f"n_{i}").alias("changed"),
            )
            for i, (t, _) in enumerate(changes)
        ]
    )
    return counts.select(F.inline(rows))


def sample_definition(df: DataFrame, domain: str, weight: str | None = None) -> DataFrame:
    """One row describing a development sample: domain, rows and weight sum."""
    if domain not in ("ttd", "otb"):
        raise ValueError("domain must be ttd or otb")
    if weight is not None:
        if weight not in df.columns:
            raise ValueError(f"weight column {weight!r} not found")
        if not isinstance(df.schema[weight].dataType, T.NumericType):
            raise ValueError(f"weight column {weight!r} is not numeric")
    total = F.sum(col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("row_count"), total.alias("weight_sum")).select(
        F.lit(domain).alias("domain"), "row_count", "weight_sum"
    )


# --- through-the-door population ---------------------------------------------

FINANCED = "_ri_financed"


@dataclass(frozen=True)
class RejectRules:
    """``source`` (ttd only): target_missing or flag_column with its values.

    The default flag values are fixed: "1", "true", "yes".
    """

    domain: str = "ttd"
    source: str = ""
    flag_column: str = ""
    flag_values: tuple[str, ...] = ("1", "true", "yes")
    exclude: tuple[tuple[str, str, tuple[str, ...]], ...] = ()  # (category, column, values)

    def __post_init__(self) -> None:
        if self.domain == "ttd" and self.source not in ("target_missing", "flag_column"):
            raise ValueError("a through-the-door sample needs a rejection source")


def _population(df: DataFrame, target: TargetSpec, rules: RejectRules) -> tuple[Column, Column]:
    excluded = F.lit(False)
    for category, column, values in rules.exclude:
        if column not in df.columns:
            raise ValueError(f"exclusion category {category!r} names unknown column {column!r}")
        hit = col(column).cast("string").isin(*[str(v) for v in values])
        excluded = excluded | F.coalesce(hit, F.lit(False))
    financed = ~excluded
    if rules.domain == "ttd":
        financed = financed & target.is_known
        if rules.source == "flag_column":
            flag = col(rules.flag_column).cast("string").isin(*rules.flag_values)
            financed = financed & ~F.coalesce(flag, F.lit(False))
    return excluded, financed


def classify_population(df: DataFrame, target: TargetSpec, rules: RejectRules) -> DataFrame:
    """Drop excluded rows and mark the rest as financed or not."""
    excluded, financed = _population(df, target, rules)
    return df.filter(~excluded).withColumn(FINANCED, financed)


def reject_population(df: DataFrame, target: TargetSpec, rules: RejectRules) -> DataFrame:
    """One row of population counts."""
    excluded, financed = _population(df, target, rules)
    indeterminate = target._in(target.indeterminate) if target.indeterminate else F.lit(False)
    unlabeled = ~excluded & col(target.column).isNotNull() & ~target.is_known & ~indeterminate
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(financed).alias("financed_rows"),
        count_if(~excluded & ~financed).alias("non_financed_rows"),
        count_if(excluded).alias("excluded_rows"),
        count_if(indeterminate).alias("indeterminate_rows"),
        count_if(unlabeled).alias("unlabeled_accepted_rows"),
    )


def reject_none(classified: DataFrame) -> DataFrame:
    """No inference: keep financed rows only (assumes rejects are missing at random)."""
    return classified.filter(col(FINANCED)).drop(FINANCED)


def source_coverage(df: DataFrame, sources: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Coverage and missingness of the columns each data source declares."""
    present = sorted({c for _, cols in sources for c in cols if c in df.columns})
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(col(c)).alias(f"_f_{i}") for i, c in enumerate(present)]
    )
    share = F.array(
        F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("coverage")),
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.when(F.col("_n") > 0, F.round(F.col(f"_f_{i}") / F.col("_n"), 4)).alias("coverage"),
            )
            for i, c in enumerate(present)
        ],
    )
    measured = counts.select(F.inline(share))
    declared = constants(df, [(s, c) for s, cols in sources for c in cols], "source string, column string")
    return declared.join(measured, "column", "left").select(
        "source",
        "column",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.round(F.lit(1.0) - F.coalesce("coverage", F.lit(0.0)), 4).alias("missingness"),
    )


def feature_health(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features, features over half null, and too many features per row."""
    present = [c for c in features if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_if(col(c).isNull()).alias(f"_m_{i}") for i, c in enumerate(present)],
    )
    wide = F.lit(float(len(features))) / F.greatest(F.col("_n"), F.lit(1))
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            (
                F.round(F.col(f"_m_{present.index(c)}") / F.greatest(F.col("_n"), F.lit(1)), 6)
                if c in present
                else F.lit(None).cast("double")
            ).alias("value"),
            (
                F.when(F.col(f"_m_{present.index(c)}") > F.col("_n") * F.lit(0.5), F.lit("HIGH_NULL_FEATURE")).otherwise(
                    F.lit("OK")
                )
                if c in present
                else F.lit("MISSING_FEATURE_COLUMN")
            ).alias("code"),
        )
        for c in features
    ]
    rows.append(
        F.struct(
            F.lit("(all features)").alias("feature"),
            F.round(wide, 6).alias("value"),
            F.when(F.col("_n") == 0, F.lit("NO_TRAINING_DATA"))
            .when(wide > 0.5, F.lit("HIGH_DIMENSIONALITY"))
            .otherwise(F.lit("DIMENSIONALITY_OK"))
            .alias("code"),
        )
    )
    return counts.select(F.inline(F.array(*rows)))
