"""Seeded hash order: reproducible sampling that ignores partitioning.

Rows are ordered by the md5 of a unique key and a seed.  Hex prefixes of the
md5 are even buckets whatever the data look like, so the k-th row of a group is
found from bucket counts plus a sort of the one bucket that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import col, null_safe_join
from scorelake.functions.state import small_side

PREFIX_HEX = 4  # 65,536 buckets per group
MAX_OFFSETS = 2 * 16**PREFIX_HEX  # rows of bucket offsets that are broadcast: those of two groups


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """md5 of the keys and the seed; a null key has a sign of its own, so it cannot pass for another's place."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("\x00")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def uniform(keys: Sequence[Column], seed: int) -> Column:
    """A hashed number in [0, 1) from key columns: 52 bits of their md5."""
    told = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _bucket_offsets(hashed: DataFrame, by: list[str]) -> DataFrame:
    counts = hashed.groupBy(*by, F.substring("_h", 1, PREFIX_HEX).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    group = by or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def rank_cutoffs(hashed: DataFrame, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Hash value of chosen ranks: ``(by..., cut, h, k, upto)``; ``upto`` rows have that hash or a lower one.

    ``hashed`` has the hash in ``_h``; ``wanted`` is a small table
    ``(by..., cut, k)`` of 1-based ranks.  Ranks below 1 have no row.
    """
    by = list(by)
    offsets = _bucket_offsets(hashed, by)
    ranked = null_safe_join(offsets, wanted, by)
    chosen = small_side(
        ranked.filter((F.col("k") > F.col("_offset")) & (F.col("k") <= F.col("_offset") + F.col("_n"))).select(
            *by, "_bucket", "_offset", "cut", "k"
        )
    )
    buckets = small_side(chosen.select(*by, "_bucket", "_offset").distinct())
    rows = hashed.select(*by, "_h", F.substring("_h", 1, PREFIX_HEX).alias("_bucket"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h")
    numbered = null_safe_join(rows, buckets, by + ["_bucket"]).withColumn(
        "k", F.col("_offset") + F.row_number().over(inside)
    ).withColumn("_upto", F.col("_offset") + F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    return small_side(
        null_safe_join(numbered.select(*by, "k", "_h", "_upto"), chosen.select(*by, "k", "cut"), by + ["k"]).select(
            *by, "cut", F.col("_h").alias("h"), "k", F.col("_upto").alias("upto")
        )
    )


def refuse_ties(cutoffs: DataFrame, keys: Sequence[str]) -> None:
    """Keys that repeat at a cut-off leave no exact size to keep."""
    if not cutoffs.filter("upto > k").isEmpty():
        raise ValueError(f"the keys {list(keys)} repeat where the sample is cut; name columns that tell rows apart")


def dense_index(hashed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_index``: 0-based position of each row in the hash order of its group."""
    by = list(by)
    bucketed = hashed.withColumn("_bucket", F.substring("_h", 1, PREFIX_HEX))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h")
    numbered = bucketed.withColumn("_local", F.row_number().over(inside) - F.lit(1))
    offsets = _bucket_offsets(hashed, by).drop("_n")
    return (
        null_safe_join(numbered, offsets, by + ["_bucket"])
        .withColumn("_index", F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )


def lean_index(hashed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`dense_index` without ``_h``, for rows whose later order does not matter: they are exchanged once, with half the hash.

    The bucket offsets are counted first and broadcast, and a hash travels as bytes behind its bucket.
    """
    by = list(by)
    offsets = small_side(_bucket_offsets(hashed, by).drop("_n"), MAX_OFFSETS)
    bucketed = hashed.withColumns(
        {"_bucket": F.substring("_h", 1, PREFIX_HEX), "_h": F.unhex(F.substring("_h", PREFIX_HEX + 1, 32 - PREFIX_HEX))}
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h")
    numbered = bucketed.withColumn("_local", F.row_number().over(inside) - F.lit(1)).drop("_h")
    return (
        null_safe_join(numbered, offsets, by + ["_bucket"])
        .withColumn("_index", F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )
