"""Importing tables: CSV / TSV / Parquet, overrides, null strings and row caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.columns import col

# Logical override types and accepted encodings.
OVERRIDE_TYPES = {"string": "string", "int64": "bigint", "float64": "double", "boolean": "boolean"}
ENCODINGS = ("utf-8", "latin-1", "utf-16", "ascii")
_JAVA_ENCODINGS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16", "ascii": "US-ASCII"}


def infer_format(path: str) -> str:
    low = path.lower().rstrip("/")
    for suffix, kind in ((".parquet", "parquet"), (".csv", "csv"), (".tsv", "tsv")):
        if low.endswith(suffix):
            return kind
    raise ValueError(f"cannot infer the format of {path!r}; name it explicitly")


def _inferred(text: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Narrowest of bigint, double, boolean, string that every value of the column fits: one aggregate over all rows."""
    tests = {"bigint": "bigint", "double": "double", "boolean": "boolean"}
    row = text.agg(
        *[F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[
            F.count(col(c).try_cast(t)).alias(f"{t}_{i}")
            for i, c in enumerate(columns)
            for t in tests
        ],
    ).first()
    kinds = {}
    for i, c in enumerate(columns):
        filled = row[f"n_{i}"]
        kinds[c] = next((t for t in tests if filled and row[f"{t}_{i}"] == filled), "string")
    return kinds


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    header: bool = True,
    encoding: str = "utf-8",
    null_values: Sequence[str] = (),
    overrides: Mapping[str, str] | None = None,
) -> DataFrame:
    """Delimited text with types inferred from all rows and overridden by name.

    Inference reads the file once more; naming every column in ``overrides`` avoids it.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    overrides = dict(overrides or {})
    unknown = [t for t in overrides.values() if t not in OVERRIDE_TYPES]
    if unknown:
        raise ValueError(f"unknown override types {unknown}")
    if delimiter is None:
        delimiter = "\t" if path.lower().rstrip("/").endswith(".tsv") else ","
    text = spark.read.csv(
        path, sep=delimiter, header=header, encoding=_JAVA_ENCODINGS[encoding], inferSchema=False
    )
    missing = [c for c in overrides if c not in text.columns]
    if missing:
        raise ValueError(f"overrides name unknown columns {missing}")

    def clean(c: str) -> Column:
        return F.when(col(c).isin(*null_values), F.lit(None)).otherwise(col(c)) if null_values else col(c)

    cleaned = text.select(*[clean(c).alias(c) for c in text.columns])
    open_columns = [c for c in text.columns if c not in overrides]
    kinds = _inferred(cleaned, open_columns) if open_columns else {}
    kinds.update({c: OVERRIDE_TYPES[t] for c, t in overrides.items()})
    return cleaned.select(*[col(c).cast(kinds[c]).alias(c) for c in text.columns])


def read_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Any supported file; an empty table is an error."""
    kind = kind or infer_format(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df = read_csv(spark, path, delimiter=options.pop("delimiter", "\t" if kind == "tsv" else ","), **options)
    else:
        raise ValueError(f"unknown format {kind!r}")
    if df.isEmpty():
        raise ValueError(f"{path!r} has no rows")
    return df


def cap_rows(df: DataFrame, order_by: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in key order (Spark tables have no file order)."""
    if limit < 1:
        raise ValueError("row limit must be positive")
    return df.orderBy(*[col(c) for c in order_by]).limit(limit)


def cap_warning(df: DataFrame, limit: int) -> DataFrame:
    """One row: source rows, kept rows and the warning code when the cap applied."""
    return df.agg(F.count(F.lit(1)).alias("source_rows")).select(
        "source_rows",
        F.least("source_rows", F.lit(limit).cast("long")).alias("kept_rows"),
        F.when(F.col("source_rows") > limit, F.lit("SOURCE_ROW_LIMIT_APPLIED")).alias("warning"),
    )
