"""Dataset profile and quality warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scorelake.functions.columns import col, constants, count_if, numeric_columns, ratio, unpivot_values

# Thresholds of the quality checks.
NEAR_UNIQUE_RATIO = 0.95
NEAR_UNIQUE_MIN_ROWS = 20
DOMINANT_RATIO = 0.95
HIGH_CARDINALITY_VALUES = 50
HIGH_CARDINALITY_RATIO = 0.5
NULL_HEAVY_RATIO = 0.5
STRING_NUMERIC_RATIO = 0.9
DATE_LIKE_RATIO = 0.8

# Column-name patterns.
ID_NAMES = (
    "id", "_id", "customer_id", "application_id", "loan_id",
    "account_id", "uuid", "user_id", "client_id", "policy_id",
)
DATE_NAMES = (
    "date", "_dt", "timestamp", "time", "opened_at", "closed_at", "created_at",
    "updated_at", "application_date", "decision_date",
)
LEAKAGE_NAMES = (
    "default", "bad", "chargeoff", "writeoff", "delinq", "dpd", "arrears",
    "collection", "recovery", "loss", "outcome", "performance", "post_",
)

# Date formats a string column is tried against (first 19
# characters), each with the shape that is worth parsing.
DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n, nulls, min, max, mean, std)`` in one aggregate, no shuffle of rows."""
    names = list(columns or numeric_columns(df))
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(names):
        x = col(c).cast("double")
        aggregates += [
            F.count(x).alias(f"n_{i}"), F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}"),
            F.avg(x).alias(f"avg_{i}"), F.stddev_samp(x).alias(f"sd_{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n_{i}").alias("n"),
                (F.col("_n") - F.col(f"n_{i}")).alias("nulls"),
                F.col(f"lo_{i}").alias("min"),
                F.col(f"hi_{i}").alias("max"),
                F.round(f"avg_{i}", 4).alias("mean"),
                F.round(f"sd_{i}", 4).alias("std"),
            )
            for i, c in enumerate(names)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def profile_nulls(df: DataFrame) -> DataFrame:
    """``(column, dtype, row_count, null_count)`` for every column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[count_if(col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(df.columns)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("_n").alias("row_count"),
                F.col(f"m_{i}").alias("null_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(rows))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def name_warning(column: str) -> str | None:
    """First matching name pattern: identifier, date, then leakage."""
    low = column.lower()
    if any(low == p or low.endswith("_" + p) or low.startswith(p + "_") for p in ID_NAMES):
        return "SUSPECT_ID_COLUMN"
    if any(p in low for p in DATE_NAMES):
        return "SUSPECT_DATE_COLUMN"
    if any(p in low for p in LEAKAGE_NAMES):
        return "SUSPECT_LEAKAGE_COLUMN"
    return None


def column_statistics(df: DataFrame) -> DataFrame:
    """Per column: rows, non-null rows, distinct values and the largest value count.

    Exact: values are counted per (column, value), with map-side combining, then
    per column in two steps so a wide column is not funnelled into one task.
    """
    names = df.columns
    kinds = {c: c in numeric_columns(df) for c in names}
    long = unpivot_values(df, names, [], cast="string")
    per_value = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    stats = per_value.groupBy("variable").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("filled"),
        count_if(present).alias("distinct_values"),
        F.max(F.when(present, F.col("n"))).alias("top_count"),
    )
    numeric = F.col("variable").isin(*[c for c in names if kinds[c]]) if any(kinds.values()) else F.lit(False)
    return stats.withColumn("is_numeric", numeric)


def column_warnings(df: DataFrame) -> DataFrame:
    """``(column, code, value)`` for constant, near-unique, dominant, wide and null-heavy columns."""
    s = column_statistics(df)
    filled, distinct = F.col("filled"), F.col("distinct_values")
    unique_share = ratio(distinct, filled)
    null_share = ratio(F.col("row_count") - filled, F.col("row_count"))
    top_share = ratio(F.col("top_count"), filled)

    def warn(condition: Column, code: str, value: Column) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.round(value, 6).alias("value")))

    text = ~F.col("is_numeric")
    found = F.array(
        warn((filled > 0) & (distinct <= 1), "CONSTANT_COLUMN", distinct.cast("double")),
        warn((filled >= NEAR_UNIQUE_MIN_ROWS) & (unique_share >= NEAR_UNIQUE_RATIO), "NEAR_UNIQUE_COLUMN", unique_share),
        warn(F.col("is_numeric") & (filled > 0) & (top_share >= DOMINANT_RATIO), "DOMINANT_VALUE_COLUMN", top_share),
        warn(
            text & (filled > 0) & ((distinct > HIGH_CARDINALITY_VALUES) | (unique_share >= HIGH_CARDINALITY_RATIO)),
            "HIGH_CARDINALITY_CATEGORICAL",
            distinct.cast("double"),
        ),
        warn((F.col("row_count") > 0) & (null_share >= NULL_HEAVY_RATIO), "NULL_HEAVY_COLUMN", null_share),
    )
    values = s.select(F.col("variable").alias("column"), F.explode(F.filter(found, lambda w: w.isNotNull())).alias("w"))
    return values.select("column", "w.code", "w.value")


def schema_warnings(df: DataFrame) -> DataFrame:
    """Warnings that need the column names only."""
    rows: list[tuple[str, str]] = []
    for c in df.columns:
        if not c.strip():
            rows.append((c, "BLANK_COLUMN_NAME"))
        if "duplicated" in c.lower():
            rows.append((c, "DUPLICATE_IMPORTED_COLUMN_NAME"))
        code = name_warning(c)
        if code:
            rows.append((c, code))
    return constants(df, rows, "column string, code string").withColumn("value", F.lit(None).cast("double"))


def quality_warnings(df: DataFrame) -> DataFrame:
    return schema_warnings(df).unionByName(column_warnings(df))


_EXCLUDING = (
    "SUSPECT_ID_COLUMN", "SUSPECT_DATE_COLUMN", "SUSPECT_LEAKAGE_COLUMN",
    "CONSTANT_COLUMN", "NEAR_UNIQUE_COLUMN",
)


def recommended_exclusions(warnings: DataFrame) -> DataFrame:
    return warnings.filter(F.col("code").isin(*_EXCLUDING)).select("column").distinct()


def _string_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def _share_matching(df: DataFrame, names: Sequence[str], test, threshold: float, code: str) -> DataFrame:
    counts = df.agg(
        *[F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(names)],
        *[count_if(test(col(c))).alias(f"ok_{i}") for i, c in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n_{i}").alias("filled"),
                F.col(f"ok_{i}").alias("parsed"),
                F.round(ratio(F.col(f"ok_{i}"), F.col(f"n_{i}")), 6).alias("share"),
            )
            for i, c in enumerate(names)
        ]
    )
    flagged = (F.col("filled") >= 2) & (F.col("share") >= threshold)
    return counts.select(F.inline(rows)).withColumn("code", F.when(flagged, F.lit(code)).otherwise(F.lit("OK")))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def string_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns whose values are numbers once one comma and a leading $ are removed."""

    def parses(value: Column) -> Column:
        cleaned = F.regexp_replace(F.regexp_replace(value, r"^([^,]*),", "$1"), r"^\s*\$", "")
        plain = F.trim(cleaned)  # Java's suffixes, as in 12d or 7F, are codes and not numbers
        return plain.rlike(NUMBER) & plain.try_cast("double").isNotNull()

    return _share_matching(df, _string_columns(df, columns), parses, STRING_NUMERIC_RATIO, "STRING_CODED_NUMERIC")


def string_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns whose first 19 characters parse with one of the date formats."""

    def parses(value: Column) -> Column:
        head = F.substring(value, 1, 19)
        return F.coalesce(
            *[F.when(head.rlike(shape), F.try_to_timestamp(head, F.lit(f))) for f, shape in DATE_FORMATS]
        ).isNotNull()

    return _share_matching(df, _string_columns(df, columns), parses, DATE_LIKE_RATIO, "DATE_LIKE_STRING")


def role_target_counts(df: DataFrame, target: str, role: str = "role") -> DataFrame:
    """Class counts per role, with a warning for a train role of one class."""
    counts = df.groupBy(col(role).alias("role"), col(target).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    classes = F.count(F.lit(1)).over(Window.partitionBy("role"))
    return counts.withColumn(
        "status", F.when((F.col("role") == "train") & (classes < 2), F.lit("train_needs_two_classes")).otherwise(F.lit("ok"))
    )
