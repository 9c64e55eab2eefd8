"""Balancing the training sample: undersampling, oversampling and SMOTE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import col, constants
from scorelake.functions.hashing import dense_index, hash_order, rank_cutoffs, refuse_ties, uniform
from scorelake.functions.state import stage
from scorelake.functions.target import TargetSpec
from scorelake.operators.neighbours import nearest_neighbours, neighbour_lists

SYNTHETIC = "_is_synthetic_row"


def _with_flag(df: DataFrame) -> DataFrame:
    return df if SYNTHETIC in df.columns else df.withColumn(SYNTHETIC, F.lit(False))


def _class_counts(df: DataFrame, target: TargetSpec) -> tuple[int, int]:
    row = df.agg(
        F.count(F.when(target.is_bad, 1)).alias("bad"), F.count(F.when(target.is_good, 1)).alias("good")
    ).first()
    if not row.bad or not row.good:
        raise ValueError("resampling needs both classes")
    return row.bad, row.good


def resample_sizes(n_bad: int, n_good: int, strategy: str, ratio: float) -> tuple[int, int]:
    """Target row counts (bad, good).

    A strategy names the size that its class or classes move towards; bads only
    grow, goods only shrink, and a ratio above 1 moves nothing.
    """
    towards = {
        "undersample_majority": (None, n_bad),
        "oversample_minority": (n_good, None),
        "combined": ((n_bad + n_good) // 2,) * 2,
    }
    if strategy not in towards:
        raise ValueError(f"unknown strategy {strategy!r}")
    bad, good = (None if size is None or ratio > 1.0 else int(size * ratio) for size in towards[strategy])
    return n_bad if bad is None else max(bad, n_bad), n_good if good is None else min(good, n_good)


def _keep_lowest(df: DataFrame, keys: Sequence[str], seed: int, k: int) -> DataFrame:
    """The k rows with the lowest hash; no row is shuffled."""
    hashed = df.withColumn("_h", hash_order(keys, seed))
    if k <= 0:
        return df.filter(F.lit(False))
    wanted = constants(df, [(0, "keep", k)], "_one int, cut string, k long")
    cutoffs = rank_cutoffs(hashed.select(F.lit(0).alias("_one"), "_h"), ["_one"], wanted)
    refuse_ties(cutoffs, keys)
    cut = cutoffs.first()
    return hashed.filter(F.col("_h") <= F.lit(cut.h)).drop("_h") if cut else df


def _draw(df: DataFrame, keys: Sequence[str], seed: int, draws: int) -> DataFrame:
    """``draws`` rows with replacement, as copies of their source rows."""
    hashed = df.withColumn("_h", hash_order(keys, seed))
    n = df.count()
    spark = df.sparkSession
    picks = (
        spark.range(draws)
        .select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("_index"))
        .groupBy("_index")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    return (
        dense_index(hashed)
        .join(picks, "_index")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .drop("_index", "_copies", "_copy", "_h")
    )


def resample(
    df: DataFrame,
    target: TargetSpec,
    keys: Sequence[str],
    strategy: str = "combined",
    ratio: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Exact class sizes; drawn copies are flagged synthetic, earlier flags are kept."""
    n_bad, n_good = _class_counts(df, target)
    want_bad, want_good = resample_sizes(n_bad, n_good, strategy, ratio)
    flagged = _with_flag(df)
    bad, good = flagged.filter(target.is_bad), flagged.filter(target.is_good)
    kept_good = _keep_lowest(good, keys, seed, want_good) if want_good < n_good else good
    result = bad.unionByName(kept_good)
    if want_bad > n_bad:
        extra = _draw(bad, keys, seed, want_bad - n_bad).withColumn(SYNTHETIC, F.lit(True))
        result = result.unionByName(extra)
    return result


def indexed_points(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct feature vectors with their ``copies`` and a dense ``point`` number in hash order."""
    doubles = [col(f).cast("double").alias(f) for f in features]
    distinct = df.select(*doubles).groupBy(*features).agg(F.count(F.lit(1)).alias("copies"))
    points = stage(
        distinct.withColumn("_h", F.md5(F.concat_ws("|", *[col(f).cast("string") for f in features])))
    )
    return stage(dense_index(points).withColumnRenamed("_index", "point").drop("_h"))


def smote(
    df: DataFrame,
    target: TargetSpec,
    features: Sequence[str],
    k: int = 5,
    ratio: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Synthetic minority rows on the line to one of their k nearest neighbours.

    Equal feature vectors are one point with a weight, so copies never meet each
    other pairwise; a point with copies can draw a copy as its neighbour, which
    interpolates to the point itself.  Other columns of a synthetic row are null.
    A minority row without one of the features has no place among the others and
    is an error.
    """
    n_bad, n_good = _class_counts(df, target)
    minority_is_bad = n_bad <= n_good
    n_min, n_max = min(n_bad, n_good), max(n_bad, n_good)
    if n_min < k + 1:
        raise ValueError(f"SMOTE with k={k} needs at least {k + 1} minority rows, found {n_min}")
    new_rows = int(n_max * ratio) - n_min
    flagged = _with_flag(df)
    if new_rows <= 0:
        return flagged
    minority = df.filter(target.is_bad if minority_is_bad else target.is_good)
    doubles = [col(f).cast("double").alias(f) for f in features]
    unplaced = reduce(or_, (col(f).isNull() | F.isnan(col(f)) for f in features))
    if not minority.select(*doubles).filter(unplaced).isEmpty():
        raise ValueError("SMOTE needs every feature of every minority row")
    indexed = indexed_points(minority, features)
    n_points = indexed.count()
    if n_points > 1:
        listed = neighbour_lists(indexed, features, min(k, n_points - 1), keep=["copies"]).withColumn("_near", F.col("found.neighbour"))
    else:
        listed = indexed.select("point", F.array(*doubles).alias("x"), "copies", F.lit(None).cast("array<long>").alias("_near"))
    # Each draw picks a base row in proportion to its copies, then a neighbour rank.
    quota = F.col("copies") * F.lit(float(new_rows)) / F.lit(float(n_min))
    chance = F.md5(F.concat_ws("|", "point", F.lit(seed)))
    missing = new_rows - indexed.agg(F.sum(F.floor(quota))).first()[0]
    draws = (F.floor(quota) + _extra_draws(indexed, chance, missing)).cast("int")
    drawn = listed.withColumn("draws", draws).filter("draws > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("draws"))))
    pick = F.floor(uniform([F.col("point"), F.col("draw")], seed) * F.lit(k)).cast("int") + 1
    step = uniform([F.col("draw"), F.col("point")], seed + 1)
    # Ranks up to copies - 1 are the point's own copies; such a draw stays where it is and meets its own point.
    rank = pick - (F.col("copies") - 1).cast("int")
    chosen = drawn.withColumns({"_neighbour": F.get("_near", rank - 1), "step": step})
    coordinates = indexed.select(F.col("point").alias("_met"), *[col(f).alias(f"_n_{i}") for i, f in enumerate(features)])
    drawn_to = chosen.select("x", "step", "_neighbour", F.coalesce("_neighbour", "point").alias("_met"))
    linked = drawn_to.join(coordinates, "_met")
    moved = []
    for i, f in enumerate(features):
        own = F.get("x", F.lit(i))
        towards = F.when(F.col("_neighbour").isNotNull(), own + F.col("step") * (F.col(f"_n_{i}") - own))
        moved.append(F.coalesce(towards, own).alias(f))
    label = (target.bad if minority_is_bad else target.good)[0]
    synthetic = linked.select(*moved)
    columns = []
    for field in flagged.schema.fields:
        if field.name in features:
            columns.append(col(field.name).cast("double").alias(field.name))
        elif field.name == target.column:
            columns.append(F.lit(label).cast(field.dataType).alias(field.name))
        elif field.name == SYNTHETIC:
            columns.append(F.lit(True).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    original = flagged.withColumns({f: col(f).cast("double") for f in features})
    return original.unionByName(synthetic.select(*columns))


def _extra_draws(points: DataFrame, chance: Column, count: int) -> Column:
    """1 for the ``count`` points with the lowest hash, else 0."""
    if count <= 0:
        return F.lit(0)
    hashed = points.select(chance.alias("_h"), F.lit(0).alias("_one"))
    wanted = constants(points, [(0, "extra", int(count))], "_one int, cut string, k long")
    cut = rank_cutoffs(hashed, ["_one"], wanted).first()
    return F.when(chance <= F.lit(cut.h), 1).otherwise(0)
