"""Writing tables and fingerprinting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col


def write_table(df: DataFrame, path: str, partition_by: str | None = "role") -> None:
    """zstd Parquet, partitioned by role when the table has one."""
    writer = df.write.option("compression", "zstd").mode("errorifexists")
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def export_scorecard(scorecard: DataFrame, path: str, kind: str = "csv") -> None:
    """The points table as CSV or JSON rows (one row per bin)."""
    ordered = scorecard.orderBy("variable", "bin_id")
    if kind == "csv":
        ordered.write.csv(path, header=True)
    elif kind == "json":
        ordered.write.json(path)
    else:
        raise ValueError("kind must be csv or json")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that is equal for equal tables whatever their row and column order.

    A null flag follows each value because the row hash skips nulls.
    """
    columns = sorted(df.columns)
    parts = [p for c in columns for p in (col(c), col(c).isNull())]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).cast("string").alias("content_hash"),
    ).withColumn("columns", F.lit(",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns)))
