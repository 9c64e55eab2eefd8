"""Cut-off bands and decision thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import constants, null_safe_join, ratio
from scorelake.functions.placing import place
from scorelake.functions.state import collect_state, small_side
from scorelake.functions.target import TargetSpec
from scorelake.operators.metrics import PROBABILITY, SCORE, labelled


def _cents(value: Column) -> Column:
    """Two decimals of the binary value; breaks often sit on a decimal tie."""
    return F.round(value * F.lit(100.0), 0) / F.lit(100.0)


def cutoff_bands(
    df: DataFrame, target: TargetSpec, band_count: int = 20, cutoffs: Sequence[float] | None = None
) -> DataFrame:
    """Per role and score band ``(lower, upper]``: rows, bads and rates; empty bands stay.

    ``approval_rate`` is one minus the band's share; ``approval_above`` is the
    share of rows scoring above the band's upper bound.
    """
    if band_count < 2:
        raise ValueError("band_count must be at least 2")
    ranges = collect_state(df.groupBy("role").agg(F.min(SCORE).alias("lo"), F.max(SCORE).alias("hi")))
    breaks = []
    for r in ranges:
        if r.lo is None or r.lo == r.hi:
            raise ValueError(f"score has no variance in role {r.role!r}")
        if cutoffs:
            breaks.append((r.role, sorted(float(c) for c in cutoffs)))
        else:
            step = (r.hi - r.lo) / band_count
            breaks.append((r.role, [r.lo + i * step for i in range(1, band_count)]))
    table = constants(df, breaks, "role string, breaks array<double>")
    bad = F.when(target.is_bad, F.lit(1)).otherwise(F.lit(0))
    counted = small_side(
        place(df.select("role", SCORE, bad.alias("bad")), SCORE, table, ["role"], "band")
        .groupBy("role", "band")
        .agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("bad").cast("long")).alias("bad_count"))
    )
    slots = table.select("role", "breaks", F.explode(F.sequence(F.lit(0), F.size("breaks"))).alias("band"))
    full = null_safe_join(slots, counted, ["role", "band"], "left").fillna(0, ["count", "bad_count"])
    whole = Window.partitionBy("role")
    above = whole.orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    totals = full.select(
        "*",
        F.sum("count").over(whole).alias("n"),
        F.sum("bad_count").over(whole).alias("bads"),
        F.coalesce(F.sum("count").over(above), F.lit(0)).alias("n_above"),
    )
    return totals.select(
        "role",
        (F.col("band") + 1).alias("band"),
        _cents(F.when(F.col("band") > 0, F.get("breaks", F.col("band") - 1))).alias("lower"),
        _cents(F.get("breaks", F.col("band"))).alias("upper"),
        "count",
        "bad_count",
        F.round(F.lit(1.0) - F.col("count") / F.col("n"), 4).alias("approval_rate"),
        F.round(F.col("n_above") / F.col("n"), 4).alias("approval_above"),
        F.round(ratio(F.col("bad_count"), F.col("count")), 4).alias("bad_rate"),
        F.round(ratio(F.col("bad_count"), F.col("bads")), 4).alias("capture_rate"),
    )


OBJECTIVES = ("youden", "max_f1", "max_g_mean", "cost_minimize")


def optimise_threshold(
    df: DataFrame,
    target: TargetSpec,
    objective: str = "youden",
    n_thresholds: int = 200,
    cost_fp: float = 1.0,
    cost_fn: float = 10.0,
) -> DataFrame:
    """Best of evenly spaced probability thresholds per role (first one on a tie).

    Each row falls into the bucket of the highest threshold it reaches; counts
    at or above a threshold are suffix sums over the few buckets.  ``selected``
    marks the role to decide on: test, else train, else oot.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    step = 1.0 / (n_thresholds - 1)
    last = n_thresholds - 1
    at = lambda i: F.when(i >= last, F.lit(1.0)).otherwise(i * F.lit(step))
    p = F.col(PROBABILITY)
    guess = F.floor(p * F.lit(float(last))).cast("int")
    bucket = (
        F.when((guess < last) & (at(guess + 1) <= p), guess + 1).when(at(guess) > p, guess - 1).otherwise(guess)
    )
    counted = small_side(
        labelled(df, target, PROBABILITY)
        .groupBy("role", bucket.alias("bucket"))
        .agg(F.sum(F.col("y").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    )
    totals = counted.groupBy("role").agg(F.sum("bad").alias("n_bad"), F.sum("n").alias("n_all"))
    slots = totals.filter("n_bad > 0 AND n_bad < n_all").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bucket")
    )
    full = null_safe_join(slots, counted, ["role", "bucket"], "left").fillna(0, ["bad", "n"])
    reached = Window.partitionBy("role").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        full.withColumns({"tp": F.sum("bad").over(reached), "_pos": F.sum("n").over(reached)})
        .withColumn("fp", F.col("_pos") - F.col("tp"))
        .withColumns({"fn": F.col("n_bad") - F.col("tp"), "tn": F.col("n_all") - F.col("n_bad") - F.col("fp")})
    )
    rates = cells.select(
        "role",
        "bucket",
        at(F.col("bucket")).alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        (F.lit(cost_fp) * F.col("fp") + F.lit(cost_fn) * F.col("fn")).alias("cost"),
    ).select(
        "*",
        ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        F.sqrt(F.col("recall") * F.col("specificity")).alias("g_mean"),
        (F.col("recall") + F.col("specificity") - F.lit(1.0)).alias("youden_j"),
    )
    value = {
        "youden": F.col("youden_j"),
        "max_f1": F.col("f1"),
        "max_g_mean": F.col("g_mean"),
        "cost_minimize": -F.col("cost"),
    }[objective]
    shown = ["threshold", "recall", "specificity", "precision", "f1", "g_mean", "cost", "youden_j"]
    best = rates.groupBy("role").agg(
        F.max_by(
            F.struct(value.alias("objective_value"), *shown), F.struct(value, -F.col("bucket"))
        ).alias("b")
    )
    priority = F.when(F.col("role") == "test", 0).when(F.col("role") == "train", 1).otherwise(2)
    first = F.min(priority).over(Window.partitionBy(F.lit(0)))  # one row per role
    return best.select(
        "role",
        *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ["objective_value", *shown]],
        (priority == first).alias("selected"),
    )
