"""The same scoring and stability operators on a stream of applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import null_safe_join, sql_position
from scorelake.functions.state import small_side
from scorelake.operators.scaling import Scaling
from scorelake.operators.scoring import apply_logistic
from scorelake.operators.woe import add_woe_columns


def score_stream(
    stream: DataFrame, bins: DataFrame, woe: DataFrame, coefficients: DataFrame, scaling: Scaling = Scaling()
) -> DataFrame:
    """Stateless scoring: one projection with the fitted bins and coefficients as literals."""
    added = add_woe_columns(stream, bins, woe)
    names = [c for c in added.columns if c.endswith("_woe") and c not in stream.columns]
    return apply_logistic(added.fillna(0.0, subset=names), coefficients, scaling)


def window_counts(
    stream: DataFrame, value: str, breaks: Sequence[float], event_time: str, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Rows per event-time window and ``[lo, hi)`` bin of a fixed baseline.

    State is one counter per open window and bin; windows close with the watermark.
    """
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(
            F.window(event_time, window).alias("window"),
            F.expr(sql_position(f"`{value}`", list(breaks), left_closed=True)).alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "bin", "n")
    )


def window_psi(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """PSI per window of ``(window_start, bin, n)`` against baseline ``(bin, n)`` counts.

    An empty bin counts as half a row, as in the batch measure.
    """
    expected = small_side(
        baseline.select("bin", F.col("n").alias("en")).withColumn("etotal", F.lit(baseline.agg(F.sum("n")).first()[0]))
    )
    totals = counts.groupBy("window_start").agg(F.sum("n").alias("total"))
    slots = [r.bin for r in expected.select("bin").collect()]
    every = totals.withColumn("bin", F.explode(F.array(*[F.lit(b) for b in slots])))
    full = null_safe_join(every, counts, ["window_start", "bin"], "left").fillna(0, ["n"]).join(expected, "bin")
    ep = F.when(F.col("en") == 0, F.lit(0.5) / F.col("etotal")).otherwise(F.col("en") / F.col("etotal"))
    ap = F.when(F.col("n") == 0, F.lit(0.5) / F.col("total")).otherwise(F.col("n") / F.col("total"))
    return full.groupBy("window_start").agg(
        F.max("total").alias("row_count"), F.round(F.sum((ap - ep) * F.log(ap / ep)), 6).alias("psi")
    )
