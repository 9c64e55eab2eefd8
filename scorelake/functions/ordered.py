"""Exact order statistics and running totals without a one-task sort.

``running_totals`` gives every distinct value of a column the totals of all
smaller values.  The rows are range-partitioned; the slice number of each row
is stored by a checkpoint, so slice offsets and rows always agree, and each
slice is then summed on its own.

``exact_quantiles`` reads the data twice and shuffles next to nothing: a
mergeable sketch brackets each quantile on a monotone grid, then only values in
the bracketed cells are counted one by one; other cells are just counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import col, null_safe_join, sql_number, unpivot_values
from scorelake.functions.state import materialise, small_side

SKETCH_ACCURACY = 10_000
SLICE_ROWS = 2_000_000


def slices_for(df: DataFrame, rows: int) -> int | None:
    """Tasks of ``SLICE_ROWS`` rows for an exchange of so many; None where the session's own number keeps them smaller."""
    wanted = -(-rows // SLICE_ROWS)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def running_totals(
    df: DataFrame, order_by: str, sums: Sequence[str], by: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Add ``before_<s>`` (sum over smaller values) and ``total_<s>`` per group.

    ``df`` holds one row per ``(by, order_by)``, usually value counts, so a hot
    value is one row and slices stay even.
    """
    by = list(by)
    ranged = df.repartitionByRange(slices, *by, order_by) if slices else df.repartitionByRange(*by, order_by)
    sliced = materialise(ranged.withColumn("_slice", F.spark_partition_id()))
    if slices:
        sliced = sliced.repartition(slices, *by, "_slice")
    per_slice = sliced.groupBy(*by, "_slice").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    # One row per slice and group: as many rows as partitions, not as data rows.
    group = by or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_slice.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_offset_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    # The window and the join share the (by, _slice) partitioning: one shuffle.
    within = (
        Window.partitionBy(*by, "_slice").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.select(
        "*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"_local_{s}") for s in sums]
    )
    return null_safe_join(local, offsets, by + ["_slice"]).select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_local_{s}") + F.col(f"_offset_{s}")).alias(f"before_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, value, rank)``: tie-averaged rank of every distinct non-null value.

    All columns share one count, one range partitioning and one checkpoint.
    """
    counts = (
        unpivot_values(df, columns, [])
        .filter("value IS NOT NULL")
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return running_totals(counts, "value", ["n"], ["variable"]).select(
        "variable", "value", (F.col("before_n") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias("rank")
    )


GRID_CELLS = 2048

# A monotone grid: even near the median, logarithmic in the tails.
_STRETCH = "signum({v} - centre) * log1p(abs({v} - centre) / spread)"
_CELL = (
    "least(greatest(cast(floor((" + _STRETCH + " - grid_from) * grid_scale) AS int), 0), "
    + str(GRID_CELLS - 1)
    + ")"
)


def _grid_cell(value: str) -> str:
    return _CELL.format(v=value)


def _sketch(
    df: DataFrame, columns: Sequence[str], probs: list[float], by: list[str], accuracy: int
) -> DataFrame:
    """Per group and variable: row count, grid constants and the cells to count exactly.

    ``hot`` is null when every value is to be counted exactly.
    """
    margin = 2.0 / accuracy
    brackets = [(max(0.0, p - margin), min(1.0, p + margin)) for p in probs]
    points = sorted({p for pair in brackets for p in pair} | {0.0, 0.25, 0.5, 0.75, 1.0})
    at = {p: f"edges[{i}]" for i, p in enumerate(points)}
    pairs = ", ".join(f"struct({points.index(lo)} AS lo, {points.index(hi)} AS hi)" for lo, hi in brackets)

    aggregates = []
    for i, c in enumerate(columns):
        aggregates.append(F.count(col(c)).alias(f"n_{i}"))
        aggregates.append(
            F.percentile_approx(col(c).cast("double"), points, F.lit(accuracy)).alias(f"e_{i}")
        )
    per_variable = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"), F.col(f"n_{i}").alias("n"), F.col(f"e_{i}").alias("edges")
            )
            for i, c in enumerate(columns)
        ]
    )
    grouping = [col(b) for b in by]
    spread, reach = f"{at[0.75]} - {at[0.25]}", f"{at[1.0]} - {at[0.0]}"
    centred = (
        df.groupBy(*grouping)
        .agg(*aggregates)
        .select(*grouping, F.inline(per_variable))
        .filter("n > 0")
        .select(
            "*",
            F.expr(f"{at[0.5]} AS centre"),
            F.expr(
                f"CASE WHEN {spread} > 0 THEN {spread} WHEN {reach} > 0 THEN ({reach}) / 100D ELSE 1D END AS spread"
            ),
        )
    )
    lowest, highest = _STRETCH.format(v=at[0.0]), _STRETCH.format(v=at[1.0])
    gridded = centred.select(
        "*",
        F.expr(f"{lowest} AS grid_from"),
        F.expr(
            f"CASE WHEN {highest} > {lowest} THEN {GRID_CELLS}D / ({highest} - {lowest}) ELSE 1D END AS grid_scale"
        ),
    )
    hot = (
        f"array_distinct(flatten(transform(array({pairs}), "
        f"b -> sequence({_grid_cell('edges[b.lo]')}, {_grid_cell('edges[b.hi]')}))))"
    )
    return gridded.select(
        *grouping,
        "variable",
        "n",
        "centre",
        "spread",
        "grid_from",
        "grid_scale",
        F.expr(f"CASE WHEN n >= {5 * accuracy} THEN {hot} END AS hot"),
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Linearly interpolated quantiles: ``(by..., variable, p, q, n)``.

    Nulls are ignored.  ``n`` is the non-null count.  Groups with too few rows
    for a sketch bracket to be safe are counted value by value in full.
    """
    by = list(by)
    probs = sorted({float(p) for p in probs})
    sketch = small_side(_sketch(df, columns, probs, by, accuracy))
    found = _order_statistics(df, columns, probs, by, sketch)
    if found.filter("q IS NULL").isEmpty():
        return found
    # A bracket missed its order statistic: count every value instead.
    everything = sketch.withColumn("hot", F.lit(None).cast("array<int>"))
    return _order_statistics(df, columns, probs, by, everything)


def _order_statistics(
    df: DataFrame, columns: Sequence[str], probs: list[float], by: list[str], sketch: DataFrame
) -> DataFrame:
    keys = by + ["variable"]
    long = unpivot_values(df, columns, [col(b) for b in by]).filter("value IS NOT NULL")
    placed = null_safe_join(long, sketch, keys).withColumn("cell", F.expr(_grid_cell("value")))
    exact = F.col("hot").isNull() | F.array_contains("hot", F.col("cell"))
    cells = materialise(
        placed.groupBy(*keys, "cell", F.when(exact, F.col("value")).alias("value")).agg(
            F.count(F.lit(1)).alias("cnt")
        )
    )
    per_cell = cells.groupBy(*keys, "cell").agg(F.sum("cnt").alias("cell_cnt"))
    earlier = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(
        *keys, "cell", F.coalesce(F.sum("cell_cnt").over(earlier), F.lit(0)).alias("offset")
    )
    within = (
        Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("local") + F.col("offset")
    valued = null_safe_join(
        cells.filter("value IS NOT NULL").withColumn(
            "local", F.coalesce(F.sum("cnt").over(within), F.lit(0))
        ),
        offsets,
        keys + ["cell"],
    ).select(
        *[col(k) for k in keys],
        "value",
        first.alias("first_index"),
        (first + F.col("cnt") - 1).alias("last_index"),
    )
    listed = "array(" + ", ".join(sql_number(p) for p in probs) + ")"
    position = "cast(n - 1 AS double) * p"
    wanted = sketch.select(
        *[col(k) for k in keys],
        F.expr(
            f"transform({listed}, p -> struct(p AS p, floor({position}) AS low_index,"
            f" ceil({position}) AS high_index)) AS wanted"
        ),
    )
    touched = F.expr(
        "filter(wanted, w -> w.low_index BETWEEN first_index AND last_index"
        " OR w.high_index BETWEEN first_index AND last_index)"
    )
    hits = null_safe_join(valued, wanted, keys).select(
        *[col(k) for k in keys], "value", "first_index", "last_index", F.inline(touched)
    )
    within_row = "BETWEEN first_index AND last_index THEN value END"
    found = hits.groupBy(*keys, "p").agg(
        F.expr(f"max(CASE WHEN low_index {within_row}) AS lo"),
        F.expr(f"max(CASE WHEN high_index {within_row}) AS hi"),
    )
    targets = sketch.select(*[col(k) for k in keys], "n", F.expr(f"explode({listed}) AS p"))
    return small_side(
        null_safe_join(targets, found, keys + ["p"], "left").select(
            *[col(k) for k in keys],
            "p",
            F.expr(
                f"CASE WHEN lo = hi THEN lo ELSE lo + ({position} - floor({position})) * (hi - lo) END AS q"
            ),
            "n",
        )
    )


def quantile_arrays(quantiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., variable, n, breaks)``: the distinct quantiles in ascending order."""
    return quantiles.groupBy(*by, "variable", "n").agg(
        F.array_sort(F.collect_set("q")).alias("breaks")
    )
