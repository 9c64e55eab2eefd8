"""Stratified and preassigned train / test / oot splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col, null_safe_join
from scorelake.functions.hashing import hash_order, rank_cutoffs, refuse_ties
from scorelake.functions.state import small_side

ROLES = ("train", "test", "oot")


@dataclass(frozen=True)
class SplitParams:
    train: float = 0.6
    test: float = 0.2
    oot: float = 0.2
    seed: int = 42
    min_class_fraction: float | None = None

    def __post_init__(self) -> None:
        if abs(self.train + self.test + self.oot - 1.0) > 0.001:
            raise ValueError("split fractions must sum to 1")


def stratified_split(
    df: DataFrame, target: str, keys: Sequence[str], params: SplitParams = SplitParams()
) -> DataFrame:
    """Add ``role`` with exact sizes per target class.

    ``keys`` identify a row.  Rows are not moved: two hash cut-offs per class
    are found from bucket counts, then each row compares its own hash.
    """
    hashed = df.withColumn("_h", hash_order(keys, params.seed))
    stratum = col(target).cast("string")
    # floor(n * fraction), at least one row
    sizes = small_side(
        df.groupBy(stratum.alias("_stratum"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "_stratum",
            "n",
            F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(params.train))).alias("n_train"),
            F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(params.test))).alias("n_test"),
        )
    )
    if params.min_class_fraction is not None:
        shares = [r.n for r in sizes.collect()]
        if min(shares) < params.min_class_fraction * sum(shares):
            raise ValueError("a target class is smaller than min_class_fraction")
    cuts = F.array(
        F.struct(F.lit("train").alias("cut"), F.least("n", "n_train").alias("k")),
        F.struct(F.lit("test").alias("cut"), F.least(F.col("n"), F.col("n_train") + F.col("n_test")).alias("k")),
    )
    wanted = sizes.select("_stratum", F.inline(cuts))
    narrow = hashed.select(stratum.alias("_stratum"), "_h")
    cutoffs = rank_cutoffs(narrow, ["_stratum"], wanted)
    refuse_ties(cutoffs, keys)
    wide = small_side(
        cutoffs.groupBy("_stratum").agg(
            F.max(F.when(F.col("cut") == "train", F.col("h"))).alias("_train_h"),
            F.max(F.when(F.col("cut") == "test", F.col("h"))).alias("_test_h"),
        )
    )
    role = (
        F.when(F.col("_h") <= F.col("_train_h"), F.lit("train"))
        .when(F.col("_h") <= F.col("_test_h"), F.lit("test"))
        .otherwise(F.lit("oot"))
    )
    joined = null_safe_join(hashed.withColumn("_stratum", stratum), wide, ["_stratum"])
    return joined.select(*[col(c) for c in df.columns if c != "role"], role.alias("role"))


def preassigned_split(df: DataFrame, column: str) -> DataFrame:
    """Use a column that already says train, test or oot; each must have rows."""
    kept = df.filter(col(column).isin(*ROLES))
    counts = {r[0]: r[1] for r in kept.groupBy(col(column)).count().collect()}
    empty = [r for r in ROLES if not counts.get(r)]
    if empty:
        raise ValueError(f"no rows for roles {empty}")
    return kept.withColumn("role", col(column))
