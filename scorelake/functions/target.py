"""The good/bad target: declaration, encoding and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col, constants, count_if, one_row


@dataclass(frozen=True)
class TargetSpec:
    """Values are compared as strings, so 1 and "1" declare the same class."""

    column: str
    good: tuple[str, ...]
    bad: tuple[str, ...]
    indeterminate: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.column or not self.column.strip():
            raise ValueError("target column must not be blank")
        if not self.good or not self.bad:
            raise ValueError("good and bad values must not be empty")
        if any(v is None or not str(v).strip() for v in (*self.good, *self.bad, *self.indeterminate)):
            raise ValueError("good, bad and indeterminate values must not be blank")
        groups = [set(map(str, g)) for g in (self.good, self.bad, self.indeterminate)]
        if groups[0] & groups[1] or groups[0] & groups[2] or groups[1] & groups[2]:
            raise ValueError("good, bad and indeterminate values must not overlap")

    def _in(self, values: tuple[str, ...]) -> Column:
        return F.coalesce(col(self.column).cast("string").isin(*[str(v) for v in values]), F.lit(False))

    @property
    def is_bad(self) -> Column:
        return self._in(self.bad)

    @property
    def is_good(self) -> Column:
        return self._in(self.good)

    @property
    def is_known(self) -> Column:
        return self._in(self.good + self.bad)

    @property
    def label(self) -> Column:
        """1 for bad, 0 for good, null for anything else."""
        return F.when(self.is_bad, F.lit(1)).when(self.is_good, F.lit(0))


def encode_target(df: DataFrame, target: TargetSpec, strict: bool = True, output: str = "label") -> DataFrame:
    """Add the 0/1 label.

    Strict: every value must be declared good or bad.  Otherwise declared
    indeterminate values become 0 and only undeclared ones are an error.
    """
    if target.column not in df.columns:
        raise ValueError(f"target column {target.column!r} not found")
    allowed = target.good + target.bad + (() if strict else target.indeterminate)
    unknown = df.filter(~target._in(allowed)).select(col(target.column).cast("string").alias("v"))
    found = [r.v for r in unknown.limit(1).collect()]
    if found:
        raise ValueError(f"target column {target.column!r} holds undeclared values such as {found[0]!r}")
    return df.withColumn(output, F.when(target.is_bad, F.lit(1)).otherwise(F.lit(0)))


def target_counts(df: DataFrame, target: TargetSpec) -> DataFrame:
    """One row: how many rows each encoding rule would accept or reject."""
    declared = target._in(target.good + target.bad + target.indeterminate)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        count_if(target.is_bad).alias("bad_count"),
        count_if(target.is_good).alias("good_count"),
        count_if(target._in(target.indeterminate) if target.indeterminate else F.lit(False)).alias(
            "indeterminate_count"
        ),
        count_if(~target.is_known).alias("strict_violations"),
        count_if(~declared).alias("undeclared_count"),
    )


def target_audit(df: DataFrame, target: TargetSpec) -> DataFrame:
    """Declared versus observed values, one row each, with a status."""
    declared = constants(
        df,
        [(str(v), "good") for v in target.good]
        + [(str(v), "bad") for v in target.bad]
        + [(str(v), "indeterminate") for v in target.indeterminate],
        "value string, declared_as string",
    )
    observed = df.groupBy(col(target.column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    missing_rule = F.when(
        F.col("declared_as").isin("good", "bad"), F.lit("declared_not_observed")
    ).otherwise(F.lit("ok"))
    return (
        observed.join(declared, observed.value.eqNullSafe(declared.value), "full_outer")
        .select(
            F.coalesce(observed.value, declared.value).alias("value"),
            F.coalesce("declared_as", F.lit("undeclared")).alias("declared_as"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        )
        .withColumn(
            "status",
            F.when(F.col("value").isNull(), "null_target")
            .when(F.col("declared_as") == "undeclared", "undeclared")
            .when(F.col("n_rows") == 0, missing_rule)
            .otherwise("ok"),
        )
    )


def validate_binary_target(df: DataFrame, column: str, max_class_ratio: float | None = None) -> DataFrame:
    """Value counts of the raw target with the verdict on being binary.

    ``distinct_count`` counts null as a value.  With ``max_class_ratio`` the
    verdict also asks that the classes are not more unequal than that.
    """
    counts = df.groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n_rows")).otherwise(F.lit(0))).alias("null_count"),
        F.max("n_rows").alias("largest"),
        F.min("n_rows").alias("smallest"),
    )
    balanced = F.lit(True)
    if max_class_ratio is not None:
        balanced = F.col("total.largest") <= F.col("total.smallest") * F.lit(float(max_class_ratio))
    return counts.withColumn("total", one_row(totals)).select(
        "value",
        "n_rows",
        F.col("total.distinct_count").alias("distinct_count"),
        F.col("total.null_count").alias("null_count"),
        ((F.col("total.distinct_count") == 2) & balanced).alias("is_binary"),
    )
