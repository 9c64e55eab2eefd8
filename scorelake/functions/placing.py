"""Putting values between per-group breaks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.columns import col, null_safe_join, quote, sql_position, sql_text
from scorelake.functions.state import small_side

# Comparisons a projection may hold before breaks are joined instead.
MAX_INLINE_COMPARISONS = 600


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return sql_text(value) if isinstance(value, str) else str(value)


def place(
    df: DataFrame,
    value: str,
    breaks: DataFrame,
    by: Sequence[str] = (),
    output: str = "bin",
    left_closed: bool = False,
) -> DataFrame:
    """Add the 0-based interval of ``value`` among its group's ``breaks`` array.

    Intervals are ``(lo, hi]`` unless ``left_closed``.  Few groups become
    literals in the projection; otherwise the table of breaks is joined, and
    broadcast only if it is small.
    """
    by = list(by)
    rows = breaks.select(*[col(b) for b in by], "breaks").limit(MAX_INLINE_COMPARISONS + 1).collect()
    x = col(value)
    simple = all(isinstance(r[b], (str, int, bool, type(None))) for r in rows for b in by)
    if simple and sum(len(r.breaks) + 1 for r in rows) <= MAX_INLINE_COMPARISONS:
        positions = [sql_position(quote(value), r.breaks, left_closed) for r in rows]
        if not by:
            chosen = positions[0] if positions else "NULL"
        else:
            tests = [" AND ".join(f"{quote(b)} <=> {_literal(r[b])}" for b in by) for r in rows]
            chosen = "CASE " + " ".join(f"WHEN {t} THEN {p}" for t, p in zip(tests, positions)) + " END"
        return df.withColumn(output, F.expr(f"CASE WHEN {quote(value)} IS NOT NULL THEN {chosen} END"))
    held, at = f"_breaks_{uuid.uuid4().hex}", f"_value_{uuid.uuid4().hex}"  # no column of the caller's has these names
    side = small_side(breaks.select(*[col(b) for b in by], F.col("breaks").alias(held)))
    test = f"e <= {at}" if left_closed else f"e < {at}"
    return (
        null_safe_join(df.withColumn(at, x.cast("double")), side, by, "left")
        .withColumn(output, F.expr(f"CASE WHEN {at} IS NOT NULL THEN size(filter({held}, e -> {test})) END"))
        .drop(at, held)
    )
