"""Weight of evidence, information value and WOE columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.columns import col, count_if, null_safe_join, sql_number
from scorelake.functions.state import collect_state, small_side
from scorelake.functions.target import TargetSpec
from scorelake.operators.binning import ALL_ROWS, bin_counts, bin_diagnostics, bins_by_variable, case_by_bin


@dataclass(frozen=True)
class WoeParams:
    """``alpha`` switches additive smoothing of empty cells on.  With
    ``purpose="final"`` an empty cell is an error unless smoothed with a rationale
    (or ``zero_cell_policy`` is not "block")."""

    alpha: float | None = None
    rationale: str = ""
    purpose: str = "initial"
    zero_cell_policy: str = "block"
    enforce_monotonic: bool = False

    def __post_init__(self) -> None:
        if self.alpha is not None and self.alpha <= 0:
            raise ValueError("smoothing alpha must be positive")


def woe_cells(df: DataFrame, bins: DataFrame, target: TargetSpec, params: WoeParams = WoeParams()) -> DataFrame:
    """Unrounded WOE per bin, recounted on ``df``; small (one row per bin)."""
    counted = small_side(bin_counts(df, bins, target))
    totals = counted.filter(F.col("variable") == ALL_ROWS).select(
        F.col("good_count").alias("good"), F.col("bad_count").alias("bad")
    )
    sample = totals.first()
    if not sample.good or not sample.bad:
        raise ValueError("WOE needs at least one good and one bad row")
    per_bin = null_safe_join(
        bins.select("variable", "bin_id", "bin_order", "label"), counted, ["variable", "bin_id"], "left"
    ).fillna(0, subset=["row_count", "good_count", "bad_count"])
    with_totals = per_bin.withColumns(
        {
            "total_good": F.lit(sample.good),
            "total_bad": F.lit(sample.bad),
            "bins": F.count(F.lit(1)).over(Window.partitionBy("variable")),
        }
    )
    zero = (F.col("good_count") == 0) | (F.col("bad_count") == 0)
    good = F.col("good_count") / F.col("total_good")
    bad = F.col("bad_count") / F.col("total_bad")
    smoothed = F.lit(False)
    if params.alpha is not None:
        alpha = F.lit(float(params.alpha))
        smoothed = zero
        good = F.when(zero, (F.col("good_count") + alpha) / (F.col("total_good") + alpha * F.col("bins"))).otherwise(good)
        bad = F.when(zero, (F.col("bad_count") + alpha) / (F.col("total_bad") + alpha * F.col("bins"))).otherwise(bad)
    woe = F.when((F.col("good_dist") > 0) & (F.col("bad_dist") > 0), F.log(F.col("good_dist") / F.col("bad_dist"))).otherwise(F.lit(0.0))
    cells = (
        with_totals.withColumns({"good_dist": good, "bad_dist": bad, "zero_cell": zero, "smoothed": smoothed})
        .withColumn("woe", woe)
        .withColumn("iv_component", (F.col("good_dist") - F.col("bad_dist")) * F.col("woe"))
    )
    if params.purpose == "final" and (params.alpha is None or not params.rationale):
        if params.alpha is not None or params.zero_cell_policy == "block":
            bad_cells = cells.filter("zero_cell").select("variable", "bin_id").take(1)
            if bad_cells:
                raise ValueError(
                    f"empty cell in {bad_cells[0].variable!r} bin {bad_cells[0].bin_id!r}: "
                    "a final WOE needs smoothing with a rationale"
                )
    return cells


def woe_table(cells: DataFrame) -> DataFrame:
    """The published WOE table, rounded to six decimals."""
    return cells.select(
        "variable",
        "bin_id",
        "label",
        "row_count",
        "good_count",
        "bad_count",
        F.round("good_dist", 6).alias("good_distribution"),
        F.round("bad_dist", 6).alias("bad_distribution"),
        F.round("woe", 6).alias("woe"),
        F.round("iv_component", 6).alias("iv_component"),
    )


def iv_table(cells: DataFrame) -> DataFrame:
    """Information value per variable."""
    return cells.groupBy("variable").agg(
        F.round(F.sum("iv_component"), 6).alias("iv"),
        F.count(F.lit(1)).alias("bin_count"),
        count_if(F.col("zero_cell")).alias("zero_cell_count"),
    )


def iv_monotonic(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """IV table where variables with non-monotonic WOE are rejected with IV 0."""
    status = bin_diagnostics(woe_table(cells), bins).select("variable", "monotonic_status")
    rejected = F.col("monotonic_status") == "non_monotonic"
    return null_safe_join(iv_table(cells), status, ["variable"]).select(
        "variable",
        F.when(rejected, F.lit(0.0)).otherwise(F.col("iv")).alias("iv"),
        "bin_count",
        F.when(rejected, F.lit("REJECTED")).otherwise(F.lit("included")).alias("status"),
    )


def woe_lookup(woe: DataFrame) -> dict[tuple[str, str], float]:
    return {(r.variable, r.bin_id): r.woe for r in collect_state(woe.select("variable", "bin_id", "woe"))}


def add_woe_columns(
    df: DataFrame,
    bins: DataFrame,
    woe: DataFrame,
    variables: Sequence[str] | None = None,
    policy: str = "raise",
    suffix: str = "_woe",
) -> DataFrame:
    """Add ``<variable>_woe`` in one projection; unmatched rows get null.

    ``policy`` for a bin without WOE: raise, zero or skip_bin.
    """
    lookup = woe_lookup(woe)
    exprs = {}
    for variable, entries in bins_by_variable(bins).items():
        if variable not in df.columns or (variables is not None and variable not in variables):
            continue
        kept, values = [], []
        for e in entries:
            value = lookup.get((variable, e.bin_id))
            if value is None:
                if policy == "raise":
                    raise ValueError(f"no WOE for {variable}:{e.bin_id}")
                if policy == "skip_bin":
                    continue
                value = 0.0
            kept.append(e)
            values.append(sql_number(value))
        if kept:
            exprs[f"{variable}{suffix}"] = F.expr(case_by_bin(kept, values, entries))
    return df.withColumns(exprs)


def unmatched(df: DataFrame, woe_columns: Sequence[str], by: str = "role") -> DataFrame:
    """Rows without a WOE, per role and variable (one aggregate)."""
    counts = df.groupBy(col(by)).agg(
        F.count(F.lit(1)).alias("row_count"), *[count_if(col(c).isNull()).alias(c) for c in woe_columns]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c.removesuffix("_woe")).alias("variable"), col(c).alias("unmatched_count"))
            for c in woe_columns
        ]
    )
    return counts.select(col(by), "row_count", F.inline(pairs))


def apply_woe(
    df: DataFrame,
    bins: DataFrame,
    woe: DataFrame,
    variables: Sequence[str] | None = None,
    on_unmatched: str = "fail",
    by: str = "role",
) -> DataFrame:
    """WOE columns on any sample.  ``on_unmatched``: fail, warn or fill_zero."""
    if on_unmatched not in ("fail", "warn", "fill_zero"):
        raise ValueError("on_unmatched must be fail, warn or fill_zero")
    added = add_woe_columns(df, bins, woe, variables)
    names = [c for c in added.columns if c.endswith("_woe") and c not in df.columns]
    if on_unmatched == "fail":
        first = unmatched(added, names, by).filter("unmatched_count > 0").take(1)
        if first:
            raise ValueError(
                f"{first[0].unmatched_count} rows of {first[0].variable!r} match no bin"
            )
        return added
    return added.fillna(0.0, subset=names)
